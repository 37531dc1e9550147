"""Quality rules: counted base rules, then a calibrated logistic regression on hashed word and character n-grams.

Features of a text are the shares of its hashed byte 3- and 5-grams and of its hashed words and word
pairs (whole text, letters' case kept). The weights are fitted to labelled rows, the sigmoid over the raw
score to labelled rows that the fit has not seen. Both see at most `SAMPLE` labelled rows, chosen by a
hash of doc_id (a bound of the training data alone; every row is scored). Scoring runs in Arrow batches
without a shuffle.

Defined results: null and empty texts have zero counts and fail the base rules; without labelled rows of
both classes the model's probability is 1 for all; repeated rows give repeated rows; a doc_id with several
labels counts once for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, SPACE, bytes_of, mix, per_slice, runs_of, sums, table, word_hashes, words_of

#: Labelled rows for the fit and the calibration together, at most.
SAMPLE = 4000
BITS = 14  # a bucket of either kind fits 16 bits with a sign
CHARS, WORDS = 1 << BITS, 1 << BITS
#: Entries of rows that the fit widens to 64 bits at once.
BLOCK = 1 << 19
#: Fixed thresholds: of the base rules, and the least calibrated probability of a kept text.
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT, LEAST_PROBABILITY = 20, 8, 30, 0.5
#: Fixed value of the contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw + self.bias) + self.shift, -500, 500)))


def hashed(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: (offsets by text, bucket of each n-gram)."""
    ends, data = bytes_of(texts)
    found = []
    wide = data.astype(np.uint32)
    for size, factor in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        if len(data) >= size:
            code = wide[: len(wide) - size + 1].copy()
            for i in range(1, size):
                code = code * np.uint32(factor) + wide[i : len(wide) - size + 1 + i]
            code = (code * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
        else:
            code = np.zeros(0, np.uint32)
        found.append((_within(code, ends, size), code))
    offsets, words = words_of(texts)
    h = word_hashes(words)
    for size in (1, 2):
        code = (runs_of(h, size) >> np.uint64(64 - BITS)).astype(np.uint32) + np.uint32(CHARS)
        found.append((_within(code, offsets, size), code))
    return found


def _within(code: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Pairs (start, stop) of each text's n-grams that lie in it whole."""
    return np.stack((np.minimum(offsets[:-1], len(code)), np.minimum(np.maximum(offsets[1:] - size + 1, offsets[:-1]), len(code))))


def shares(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Raw score: for each kind of n-gram the mean weight over the text, summed."""
    total = np.zeros(len(texts))
    for (start, stop), code in hashed(texts):
        before = np.concatenate(([0.0], np.cumsum(weights[code])))
        total += (before[stop] - before[start]) / np.maximum(stop - start, 1)
    return total


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, share) of each text, sparse; at most CHARS + WORDS entries."""
    kinds, out = hashed(texts), []
    for i in range(len(texts)):
        dense = np.zeros(CHARS + WORDS)
        for (start, stop), code in kinds:
            if stop[i] > start[i]:
                dense += np.bincount(code[start[i] : stop[i]], minlength=CHARS + WORDS) / (stop[i] - start[i])
        at = np.flatnonzero(dense)
        out.append((at, dense[at]))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch steps of adaptive size; rows stay as they are and are read in blocks of about `BLOCK` entries."""
    sizes = np.array([len(a) for a, _ in rows])
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK, prepend=-1))
    blocks = list(zip(cuts, [*cuts[1:], len(rows)], strict=True))

    def joined(lo, hi):
        return np.concatenate([a for a, _ in rows[lo:hi]]), np.concatenate([v for _, v in rows[lo:hi]]).astype(float), np.repeat(np.arange(hi - lo), sizes[lo:hi])

    w, b = np.zeros(CHARS + WORDS), 0.0
    square = np.zeros(len(w))
    for lo, hi in blocks:
        at, x, _ = joined(lo, hi)
        square += np.bincount(at, weights=x * x, minlength=len(w))
    scale = np.sqrt(square / len(rows)) + 1e-4  # rare n-grams weigh as much as common ones
    unit = 1 / scale / np.sqrt(sizes.sum() / len(rows))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        g, own = np.append(penalty * w, 0.0), w * unit
        for lo, hi in blocks:
            at, x, row = joined(lo, hi)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * own[at], minlength=hi - lo) + b, -500, 500)))
            error = (p - labels[lo:hi]) / len(rows)
            g[:-1] += np.bincount(at, weights=x * error[row], minlength=len(w)) * unit
            g[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * unit, b


def calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid over raw scores, by Newton's method on targets drawn in a little from 0 and 1."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + c, -500, 500)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * raw).sum(), d.sum()])
        hess = np.array([[(h * raw * raw).sum() + 1e-6, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), c


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(text, label, fold) of at most `limit` labelled rows, the first in the order of a hash of doc_id."""
    few = (
        chosen(labels, doc_id="doc_id", label=column).withColumn("label", F.col("label").cast("int"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "label")
        .limit(limit)
    )
    rows = chosen(docs, "doc_id", "text")
    return rows.join(F.broadcast(few), "doc_id").select("text", "label", "order")  # `limit` rows at most


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    """Fitted to four fifths of the sampled rows, calibrated on the last fifth; None without both classes in either."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = features(batch.column(0))
        lists = [pa.array([a.astype(np.int16) for a, _ in rows], pa.list_(pa.int16())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([*lists, batch.column(1), batch.column(2)], names=["at", "x", "label", "order"])

    sample = labelled_sample(docs, labels, "quality", limit)
    got = sample.mapInArrow(per_slice(work), "at array<short>, x array<float>, label int, order long").toArrow()
    y, order = got.column("label").to_numpy(), got.column("order").to_numpy()
    turn = np.lexsort((y, order))  # rows stay in the chunks they came in, 6 bytes an entry
    every = []
    for chunk in got.to_batches():
        at, x = chunk.column("at"), chunk.column("x")
        every += [(at[i].values.to_numpy(), x[i].values.to_numpy()) for i in range(len(chunk))]
    rows, y = [every[i] for i in turn], y[turn].astype(float)
    held = np.arange(len(y)) % 5 == 4
    if any(len(set(y[part])) < 2 for part in (held, ~held)):
        return None
    w, b = fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held])
    raw = np.array([(w[a] * v).sum() for (a, v), h in zip(rows, held, strict=True) if h]) + b
    return Model(w.astype(np.float32).astype(np.float64), b, *calibrate(raw, y[held]))


_KINDS = np.zeros(256, np.uint8)
_KINDS[: 0x80] = 1
_KINDS[0xC0:] = 1  # first bytes of longer characters
_KINDS[[ord(c) for c in SPACE]] = 0
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def repeated_lines(text: str | None) -> int:
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return again


def repeated_words(offsets: np.ndarray, h: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words inside `size`-word windows that occur twice or more in it."""
    n, texts = len(h), len(offsets) - 1
    if n < size:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    window = runs_of(h, size)
    fits = owner[: n - size + 1] == owner[size - 1 :]
    window = mix(window ^ mix(owner[: n - size + 1].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(window[fits])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(n + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
        start = np.flatnonzero((twice[at] == window) & fits)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), offsets)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    ends, data = bytes_of(texts)
    offsets, words = words_of(texts)
    return {
        "n_words": np.diff(offsets),
        "word_chars": sums(_KINDS[data], ends),
        "n_symbols": sums(_SYMBOL[data], ends),
        "n_dup_lines": np.fromiter(map(repeated_lines, texts.to_pylist()), np.int64, len(texts)),
        "n_repeat_words": repeated_words(offsets, word_hashes(words)),
    }


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts, base verdict, calibrated probability and verdict of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # CHARS + WORDS weights

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = batch.column(1), shared.value
        c = base_counts(texts)
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
        p = np.ones(len(texts)) if own is None else own.probability(shares(texts, own.weights))
        columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in c.values()), pa.array(failed), pa.array(~failed & (p >= LEAST_PROBABILITY)), pa.array(p)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *c, "base_failed", "kept", "probability"])

    rows = chosen(docs, "doc_id", "text")
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return rows.mapInArrow(per_slice(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
