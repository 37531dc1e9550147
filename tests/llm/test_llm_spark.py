"""Text operators on a small corpus with nulls, empty and repeated rows, against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boundwave.llm import bpe, components, decontaminate, firsts, linededup, nearcopies, phrases, quality, queries, rans, secrets, simhash, toxicity, urlfilter

DOC = "doc_id long, text string, lang string, source string, n_chars long, rest string, score double, row_key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "é"]
    return " ".join("".join(r.choice(parts, r.integers(1, 4))) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(4)
    passage, line = prose(r, 70), "A Line that many documents share"
    out = []
    for i in range(40):
        t = prose(r, int(r.integers(1, 160)))
        if i % 5 == 1:
            t += " " + passage
        if i % 3 == 0:
            t += "\n" + line + "\n" + prose(r, 20)
        if i % 7 == 2:
            t += "\n\t" + line.upper() + " \r"
        out.append((i, t))
    out += [(50, out[6][1]), (51, out[6][1]), (52, out[8][1] + " end"), (53, ""), (54, None), (55, " \n\t\n"), (56, "x"), (57, "x\nx"), (58, prose(r, 3000)), (5, out[5][1]), (5, out[9][1])]
    out += [(60, "same words " * 40), (61, "a\nlong enough line\nlong enough line\nb"), (62, "LONG enough LINE"), (63, passage), (None, passage), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if k % 4 == 0 else "en", f"src{k % 3}", None if t is None else len(t), "r", 0.5, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_line_dedup(docs, none, texts):
    first = {}
    for i, t in texts:
        for x in (t or "").encode().split(b"\n") if i is not None else ():
            if (k := linededup.line_key(x)) is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or (k := linededup.line_key(x.encode())) is None or first[k] >= i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert rows_of(got) == sorted(want, key=str)
    assert any(w[2] for w in want) and linededup.dedup_lines(none).count() == 0


def test_first_occurrences_in_one_hot_key(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("h1"), (F.col("id") % 2).alias("h2"), (F.col("id") + 7).alias("doc_id"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    later = rows_of(firsts.later_occurrences(rows, ["at"]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert later == sorted(((i + 7, i) for i in range(2, 3000)), key=str)


def brute_windows(texts):
    first = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    for i, t in texts:
        w = WORD.findall(t or "")
        cover = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                cover[k : k + 50] = [True] * 50
        yield i, len(w), sum(cover), sha(" ".join(x for x, c in zip(w, cover) if not c))


def test_substring_dedup(docs, none, texts):
    got = phrases.dedup_phrases(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    want = sorted(brute_windows(texts), key=str)
    assert rows_of(got) == want and sum(w[2] for w in want) > 200
    assert phrases.dedup_phrases(none).count() == 0


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, linked):
    root = {n: n for n in nodes}
    for a, b in linked:
        x, y = root[a], root[b]
        if x != y:
            root = {n: min(x, y) if v in (x, y) else v for n, v in root.items()}
    return root


def test_simhash_components(docs, none, texts):
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    known = [(i, f) for i, f in fps if i is not None]
    root = grouped({i for i, _ in known}, [(a, b) for a, f in known for b, g in known if a > b and bin(f ^ g).count("1") <= 2])
    want = [(i, f - (1 << 64) if f >> 63 else f, root.get(i)) for i, f in fps]
    assert rows_of(simhash.near_duplicates(docs)) == sorted(want, key=str)
    assert rows_of(simhash.near_duplicates(docs.where("doc_id > 5"))) and simhash.near_duplicates(none).count() == 0


def test_links_with_deep_trees(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 6)
    fps = sorted({int(base[i % 6]) ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 5), replace=False)) for i in range(400)})
    points = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    root = grouped(range(len(fps)), [(i, j) for i, f in enumerate(fps) for j in range(i) if bin(f ^ fps[j]).count("1") <= 2])
    got = {x["node"]: x["root"] for x in components.components(simhash.links(points, 2, shard=20)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == root


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(3, 3)], "u long, v long")
    got = {x["node"]: x["root"] for x in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {i: 21 for i in range(22, 41)}
    assert components.components(edges.where("u < 0")).count() == 0


def test_near_copies_go(spark):
    r = np.random.default_rng(9)
    base = prose(r, 300)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:200] + ["twice"] + words[201:])
    rows = [(1, base), (2, near), (3, "".join(c.upper() if c.isascii() else c for c in base)), (4, prose(r, 300)), (5, ""), (6, None), (None, base)]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, node string")
    got = nearcopies.without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(str(x["doc_id"]) for x in got.collect()) == ["1", "4", "5", "None"]


def brute_groups(texts):
    """node -> least document of its group, over all pairs of five-word shingle sets."""
    own = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts}
    root = {i: i for i in own}
    for a in own:
        for b in own:
            if a < b and root[a] != root[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) > 0:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {k: v for k, v in root.items() if k != v}


@pytest.mark.parametrize("kind", ["family", "short"])
def test_every_similar_pair_is_joined(spark, kind):
    r = np.random.default_rng(11)
    word = lambda: f"w{r.integers(1 << 40)}"
    texts = []
    if kind == "family":  # the template in the middle; its copies are similar to it, but not to each other
        for base in (0, 1000):
            plain = [word() for _ in range(200)]
            for i in range(130):
                w = list(plain)
                for at in r.choice(200, 3 if i != 65 else 0, replace=False):
                    w[at] = word()
                texts.append((base + i, " ".join(w)))
    else:  # four of five shingles are shared: the least similarity there is
        for i in range(400):
            w = [word() for _ in range(9)]
            texts += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    got = {x["node"]: x["root"] for x in nearcopies.near_copy_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute_groups(texts)
    assert got == want and len(want) == (258 if kind == "family" else 400)


def test_bpe(docs, none, texts):
    enc = bpe.encoder(bpe.vocabulary_path())
    want = []
    for i, t in texts:
        ids = enc.library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(enc.library.decode(ids, skip_special_tokens=False))))
    assert rows_of(bpe.round_trip(docs, bpe.vocabulary_path())) == sorted(want, key=str)
    ids = bpe.encode_documents(docs, bpe.vocabulary_path())
    assert bpe.decode_documents(ids, bpe.vocabulary_path()).count() == len(texts)
    assert bpe.round_trip(none, bpe.vocabulary_path()).count() == 0


def test_token_files(spark, docs, none, texts, tmp_path):
    enc = bpe.encoder(bpe.vocabulary_path())
    size = rans.write_documents(docs, f"file://{tmp_path}/a", bpe.vocabulary_path())
    got = [tuple(x) for x in rans.read_blocks(spark, f"file://{tmp_path}/a", size).orderBy("start").collect()]
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(np.array([*enc.library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert [g[0] for g in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    at = 0
    for doc, start, n, data in got:
        assert start == at and len(data) == 4 * n and bytes(data) in ids[doc]
        ids[doc].remove(bytes(data))
        at += n
    size = rans.write_documents(none, f"file://{tmp_path}/b", bpe.vocabulary_path())
    assert rans.read_blocks(spark, f"file://{tmp_path}/b", size).count() == 0


def test_leaks(spark, docs, texts):
    plain = lambda t: [w for w in (x.strip(decontaminate.MARKS) for x in (t or "").lower().split()) if w]
    items = [(1, texts[3][1][:200]), (2, " ".join(plain(texts[58 - 12][1])[100:140]) + " odd"), (3, None), (4, ""), (5, "x"), (None, "nowhere to be found at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts:
        words = plain(t)
        for item, s in items:
            own = plain(s)
            if own:
                k = min(5, len(own))
                c = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
                for at in range(len(words) - len(own) + 1):
                    d = Counter(tuple(words[at + j : at + j + k]) for j in range(len(own) - k + 1))
                    s = decontaminate.similarity(c, d)
                    if s >= 0.8:
                        want[i, item] = max(want.get((i, item), 0), s)
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) >= 3
    assert decontaminate.leaks(docs, bench.where("item_id > 99")).count() == 0


def test_leaks_in_shorter_documents(spark):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one two three"), (3, " ".join(f"x{i}" for i in range(9)))], "item_id long, text string")
    texts = [" ".join(words[:39]), " ".join(words[:2] + words[3:]), " ".join(words[:32]), " ".join(words[:3]), "one two", " ".join(f"x{i}" for i in range(8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["start"], x["n_words"]): x["similarity"] for x in decontaminate.leaks(docs, bench).collect()}
    assert got == pytest.approx({(0, 1, 0, 39): 35 / 36, (1, 1, 0, 39): 33 / 38, (5, 3, 0, 8): 0.8})


def test_quality(spark, docs, none, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {(x["doc_id"], x["n_words"], x["n_repeat_words"], x["base_failed"]) for x in quality.judge(docs, quality.train(docs, labels)).collect()}
    want = set()
    for i, t in texts:
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want.add((i, len(w), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    assert got == want
    assert quality.train(docs, labels.where("quality = 1")) is None and quality.judge(none, None).count() == 0


def test_quality_calibration_separates():
    r = np.random.default_rng(0)
    raw = r.normal(0, 1, 500)
    label = (raw + r.normal(0, 0.5, 500) > 0).astype(float)
    a, c = quality.calibrate(raw, label)
    p = 1 / (1 + np.exp(-(a * raw + c)))
    assert abs(p.mean() - label.mean()) < 0.02 and a > 1


def test_toxicity(spark, none):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        bad, form = i % 5 == 0, ["zorgle", "z0rgle", "ZORGLE!!", "z o r g l e"][i // 5 % 4]
        w = prose(r, 30).split()
        if bad:
            w.insert(10, form)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(400, None), (401, ""), (None, "zorgle")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in toxicity.scores(docs, scorer).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.9
    assert got[400] == got[401] < 0.5 and got[None] >= 0.5
    flags = {x[0]: x[1] for x in docs.select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()}
    assert [i for i, _ in labels if flags[i]] == held and flags[None] is False
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.scores(docs, empty).collect()} == {0.0} and toxicity.scores(none, scorer).count() == 0


def test_secrets(spark, none):
    text = "é words and password=b7db7aa4a5fcc78305 or not"
    docs = spark.createDataFrame([(1, text, None), (1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of it", "d")], "doc_id long, text string, source string")
    forest = secrets.train(secrets.labelled_findings())
    got = secrets.findings(docs, forest, "source").collect()
    assert [(x["doc_id"], text[x["start"] : x["start"] + x["length"]]) for x in got] == [(1, "b7db7aa4a5fcc78305")] * 2
    assert secrets.findings(docs, None).count() == 3 and secrets.findings(none, forest, "source").count() == 0


URLS = [
    "http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "https://x.org", "https://x.org/?", "no scheme", None, "://org/a", "http://a.b.com/fr/1#t", "http://com/de/", "http://com:80/de/",
    "http://.org/a", "http://org./a", "http://a..org/", "http://example.org/en/2", "http://notexample.org/es/", "http://a.net/fr/", "x://y.com/de/z://q.org/", "http://e.com/DE/", "", "http://example.org/en/1\n2", "http://example.org/en/1\U0010ffffx", "s://a\x02org/x", "s://\U0010ffff.org/es/", "s://example.org", "s://org.example/es/",
]


def test_url_rules(spark):
    rows = [(k % 17, u) for k, u in enumerate(URLS)] + [(1, URLS[1]), (1, URLS[1]), (None, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = []
    for page, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", rest).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want.append((page, host, path, best[2], best[3]))
    assert rows_of(urlfilter.judge(pages, urlfilter.rules_frame(spark))) == sorted(want, key=str)
    nested = [("org", "/", "block"), ("org", "/a/", "allow"), ("org", "/a/b", "block"), ("x.org", "/a", "allow")]
    got = {x["path"]: x["rule"] for x in urlfilter.judge(spark.createDataFrame([(1, f"s://x.org{p}") for p in ("/", "/a", "/a/", "/a/b/c", "/b", "/a/c")], "page_id long, url string"), urlfilter.rules_frame(spark, nested)).collect()}
    assert got == {"/": "org/", "/a": "x.org/a", "/a/": "x.org/a", "/a/b/c": "org/a/b" if len("org/a/b") > len("x.org/a") else "x.org/a", "/b": "org/", "/a/c": "x.org/a"}
    assert urlfilter.judge(pages.where("page_id < 0"), urlfilter.rules_frame(spark)).count() == 0
    assert {x["verdict"] for x in urlfilter.judge(pages, urlfilter.rules_frame(spark).where("host = ''")).collect()} == {"allow"}


def test_registered_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, folder), con.sql(sql)
        order = sorted(got.columns)
        assert sorted(want.columns) == order
        at = [want.columns.index(c) for c in order]
        assert rows_of(got.select(*order)) == sorted((tuple(x[i] for i in at) for x in want.fetchall()), key=str)


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(3)
    base, item = prose(r, 200), prose(r, 40)
    rows = [(i, prose(r, 60)) for i in range(60)]
    rows = [(i, t + (" zorgle" if i % 4 == 0 else "")) for i, t in rows]
    rows += [(70, base), (71, base), (72, base.replace(base.split()[90], "changed", 1)), (73, prose(r, 50) + " " + item.upper()), (74, "one shared line of text\n" + prose(r, 30)), (75, "one shared line of text\n" + prose(r, 30)), (76, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x["n_tokens"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 71 lost its only line to 70; it and the null text 76 are then copies of each other
    assert set(got) == {i for i in range(60) if i % 4} | {70, 71, 74, 75} and got[71] == 0
    step = corpus_pipeline.drop_repeated_lines(spark, frame, str(tmp_path))
    assert step.columns == frame.columns
    kept = {x["doc_id"]: (x["text"], x["n_chars"]) for x in step.collect()}
    assert kept[75] == (rows[-2][1].split("\n")[1], len(rows[-2][1].split("\n")[1])) and kept[74][0] == rows[-3][1]
