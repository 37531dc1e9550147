"""Edges of all text operators: very long texts and tokens, empty tables, clashing columns, and the pipeline against a brute-force chain."""

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from boundwave.llm.secrets import op3_secrets
from boundwave.llm import bpe, decontaminate, linededup, nearcopies, phrases, quality, rans, secrets, simhash, toxicity, urlfilter

NAMES = "kept n_lines n_dropped fp component_id node root run at ids id part key state label order h1 h2 row_key rest score text_key shard c0 c1 value probability start similarity".split()


def words(r, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "é"]
    return ["".join(r.choice(parts, r.integers(1, 4))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")


def runs_of_all(docs, labels, bench, folder):
    """Every operator over `docs`: name -> DataFrame."""
    spark = docs.sparkSession
    path = bpe.vocabulary_path()
    size = rans.write_documents(docs, folder, path)
    return {
        "leaks": decontaminate.leaks(docs, bench),
        "lines": linededup.dedup_lines(docs),
        "secrets": secrets.findings(docs, secrets.train(secrets.labelled_findings(400))),
        "toxicity": toxicity.scores(docs, toxicity.train(docs, labels)),
        "bpe": bpe.round_trip(docs, path),
        "urls": urlfilter.judge(docs, urlfilter.rules_frame(spark), id_column="doc_id", url_column="text"),
        "phrases": phrases.dedup_phrases(docs),
        "tokens": rans.read_blocks(spark, folder, size),
        "simhash": simhash.near_duplicates(docs),
        "quality": quality.judge(docs, quality.train(docs, labels)),
        "near": nearcopies.without_near_copies(docs),
    }


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(words(r, 60)) + (" zorgle" if i % 3 == 0 else "")) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(words(r, 30)))], "item_id long, text string")
    return rows, labels, bench


def test_empty_tables(spark, small, tmp_path):
    rows, labels, bench = small
    docs = frame(spark, rows)
    for d, la, b in ((docs.where("doc_id < 0"), labels, bench), (docs.where("doc_id < 0"), labels.where("doc_id < 0"), bench.where("item_id < 0"))):
        found = runs_of_all(d, la, b, f"file://{tmp_path}/{la.count()}")
        assert {k: v.count() for k, v in found.items()} == dict.fromkeys(found, 0)
    assert decontaminate.leaks(docs, bench.where("item_id < 0")).count() == 0


def test_clashing_columns_change_nothing(spark, small, tmp_path):
    rows, labels, bench = small
    docs = frame(spark, rows)
    other = docs.select("*", *(F.lit("x").alias(n) for n in NAMES))
    drop = {"lines": "rest", "toxicity": None, "near": None}
    plain, odd = (runs_of_all(d, labels.withColumn("text", F.lit("x")), bench.withColumn("doc_id", F.lit(9)), f"file://{tmp_path}/{i}") for i, d in enumerate((docs, other)))
    for name in plain:
        own = [c for c in plain[name].columns if c in odd[name].columns and c != drop.get(name)]
        a, b = (sorted((tuple(r) for r in x[name].select(*own).collect()), key=str) for x in (plain, odd))
        assert a == b, name
    assert odd["near"].columns == other.columns


def test_one_very_long_text_and_token(spark, small, tmp_path):
    rows, labels, bench = small
    r = np.random.default_rng(6)
    pool = words(r, 3000)
    long = " ".join(pool[k] for k in r.integers(0, 3000, 900_000))
    token = "".join(pool[k] for k in r.integers(0, 3000, 270_000))
    assert len(long) > 4_000_000 and len(token) > 1_000_000
    docs = frame(spark, [*rows, (100, long), (101, token), (102, "start " + long)])
    found = runs_of_all(docs, labels, bench, f"file://{tmp_path}/long")
    got = {k: v.persist() for k, v in found.items()}
    assert {k: got[k].count() for k in ("lines", "toxicity", "bpe", "urls", "phrases", "tokens", "simhash", "quality")} == dict.fromkeys(("lines", "toxicity", "bpe", "urls", "phrases", "tokens", "simhash", "quality"), 43)
    assert {x["doc_id"]: x["n_removed"] for x in got["phrases"].where("doc_id >= 100").collect()} == {100: 0, 101: 0, 102: 900_000}
    assert {x["doc_id"] for x in got["near"].where("doc_id >= 100").collect()} == {100, 101}
    assert {x["doc_id"]: x["n_words"] for x in got["quality"].where("doc_id >= 100").collect()} == {100: 900_000, 101: 1, 102: 900_001}
    enc = bpe.encoder(bpe.vocabulary_path())
    want = {i: len(enc.library.encode(t, add_special_tokens=False).ids) for i, t in ((100, long), (101, token))}
    assert {x["doc_id"]: x["n_tokens"] for x in got["bpe"].where("doc_id IN (100, 101)").collect()} == want
    assert {x["doc_id"]: x["n_tokens"] - 1 for x in got["tokens"].where("doc_id IN (100, 101)").collect()} == want
    assert got["leaks"].count() == 0


def test_integer_ids(spark, small, tmp_path):
    rows, labels, bench = small
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int"))
    found = runs_of_all(docs, labels, bench, f"file://{tmp_path}/int")
    assert found["simhash"].count() == found["tokens"].count() == found["lines"].count() == len(rows)


# --- secrets in documents, against the form in which they were put there ---


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_secrets_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = []
    for d in docs.select("doc_id", "text").collect():
        text, at = d["text"] or "", 0
        while (at := text.find('token = "', at)) >= 0:
            at += len('token = "')
            want.append((d["doc_id"], at, hashlib.sha256(text[at : at + 40].encode()).hexdigest()))
    found = op3_secrets(spark, "/root/testdata/sf0.01").select("doc_id", "start", "value_sha256").collect()
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 10  # all of them, and nothing else
    assert secrets.findings(docs, None).count() > len(want)  # the forest leaves candidates out


# --- quality and base counts by brute force ---


def test_base_counts_of_many_texts(spark, small):
    r = np.random.default_rng(7)
    made = []
    for i in range(60):
        t = " ".join(words(r, int(r.integers(0, 50))))
        t += "".join(r.choice(list("#*$%&|<> \n\t\rz"), int(r.integers(0, 30))))
        made.append((i, t + "\n" + t if i % 3 == 0 else t))
    space = " \t\n\x0b\x0c\r"
    want = {}
    for i, t in made:
        w = t.translate({ord(c): " " for c in space}).split(" ")
        w = [x for x in w if x]
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.strip(space):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want[i] = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again))
    got = {x["doc_id"]: tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for x in quality.judge(frame(spark, made), None).collect()}
    assert got == want


def test_quality_verdict_by_brute_force(spark, small):
    rows, labels, _ = small
    docs = frame(spark, rows)
    model = quality.train(docs, labels)
    got = {x["doc_id"]: (x["probability"], x["kept"], x["base_failed"]) for x in quality.judge(docs, model).collect()}
    for i, t in rows:
        raw = 0.0
        for at, share in quality.features(pa.array([t])):
            raw += float((model.weights[at] * share).sum())
        p = 1 / (1 + np.exp(-(model.slope * (raw + model.bias) + model.shift)))
        assert got[i][0] == pytest.approx(p, abs=1e-9) and got[i][1] == (not got[i][2] and p >= 0.5)


# --- the pipeline against a chain of plain definitions ---


def brute_pipeline(rows, toxic, items):
    """ids and digests of what is left of `rows` (id, text), stage by stage."""
    left = [(i, t or "") for i, t in rows if i not in toxic]
    first = {}
    for i, t in left:
        for line in t.encode().split(b"\n"):
            if (k := linededup.line_key(line)) is not None:
                first[k] = min(first.get(k, i), i)
    keep = lambda i, line: (k := linededup.line_key(line.encode())) is None or first[k] >= i
    left = [(i, "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t in left]

    def fingerprint(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    texts, root = {i: (fingerprint(t), shingles(t), t.encode().lower().split()) for i, t in left}, {i: i for i, _ in left}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b]:
                (f, s, v), (g, u, w) = texts[a], texts[b]
                if bin(f ^ g).count("1") <= 2 or v == w or 5 * len(s & u) >= 4 * len(s | u) > 0:
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if x == high else x for k, x in root.items()}
    left = [(i, t) for i, t in left if root[i] == i]

    def bare(t):
        return [w for w in (x.strip(decontaminate.MARKS) for x in t.lower().split()) if w]

    def leaks(t, item):
        w, own = bare(t), bare(item)
        k = min(5, len(own))
        grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
        windows = [w[a : a + len(own)] for a in range(len(w) - len(own) + 1)] or [w]
        return any(decontaminate.similarity(grams(own), grams(x)) >= 0.8 for x in windows if len(x) >= k)

    left = [(i, t) for i, t in left if not any(leaks(t, item) for item in items)]
    enc = bpe.encoder(bpe.vocabulary_path()).library
    out = {}
    for i, t in left:
        ids = enc.encode(t, add_special_tokens=False).ids
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_pipeline_equals_a_brute_force_chain(spark, tmp_path):
    r = np.random.default_rng(12)
    item = " ".join(words(r, 40))
    base = words(r, 120)
    rows = [(i, " ".join(words(r, int(r.integers(5, 80)))) + (" zorgle" if i % 4 == 0 else "")) for i in range(80)]
    rows += [(100 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in (5, 60, 110)] + [(99, " ".join(base)), (98, " ".join(base).upper())]
    rows += [(120, item), (121, "before it " + item.upper() + " and after"), (122, " ".join(item.split()[:39])), (123, " ".join(item.split()[:20]))]
    rows += [(130 + k, "A line that several documents share\n" + " ".join(words(r, 20)) + "\n  a LINE that several documents share ") for k in range(4)] + [(140, None), (141, ""), (142, "x")]
    texts = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scorer = toxicity.train(docs, labels)
    p = scorer.probability(*scorer.evidence(pa.array([t for _, t in rows], pa.string())))
    toxic = {i for (i, _), q in zip(rows, p.tolist(), strict=True) if q >= 0.5}
    want = brute_pipeline(rows, toxic, [item])
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and {i for i in range(80) if i % 4 == 0} <= toxic and len(want) < len(rows) - 20
    assert not {105, 160, 210, 120, 121, 122} & set(want) and 123 in want


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
