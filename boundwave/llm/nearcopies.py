"""Groups of near copies: fingerprint links of `simhash`, and verified five-word similarity.

Whole-text fingerprints that vantage-point trees link (three-word shingles, two bits) join documents as
they stand. Texts that share four fifths of their five-word shingles are all found, in two steps:

* Quick links: sampled fingerprints (SimHashes of the `SAMPLE` least shingles under each of `TABLES` orders)
  bring most similar texts together; in a group of more than `ALL_PAIRS` each meets the least and the
  greatest document only. This step may miss pairs; it only spares the next one work.
* Exact links: with the shingles of every text in one order, two texts with similarity 0.8 share one of the
  first n - ceil(0.8 n) + 1 of each. All pairs that meet so and that no quick link has joined are verified,
  but for those whose sizes or places in the order leave too few shingles to share. The order puts shingles
  whose hashed counter is low first; it decides the work, not the result.

Exact copies (equal words) are put under their least document first. Pairs already joined are never listed:
in a group each text outside its most common component meets the others, so a family costs its rows.

Defined results: null, empty and blank texts are exact copies of each other; texts of fewer than five words
are one shingle; rows without doc_id are in no group and stay; rows with one doc_id are one document and
share its fate; repeated rows stay or go together; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, drop_table, mix, per_slice, without, written
from .components import components
from .simhash import fingerprint, near_duplicates, shingle_hashes

SHINGLE, SIMILARITY, TABLES, SAMPLE, ALL_PAIRS = 5, 0.8, 16, 4, 12
#: Counters of shingles (two to this power), and rows of the sorted stream, or pairs, that are handled at once.
COUNTERS, AT_ONCE = 20, 1 << 18
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64))


def sampled(hashes: np.ndarray) -> list[int]:
    """A fingerprint of the least shingles under each order; none without shingles."""
    own = np.unique(hashes)
    if not len(own):
        return []
    found = []
    for seed in _SEEDS:
        order = mix(own ^ seed)
        least = np.partition(order, SAMPLE - 1)[:SAMPLE] if len(order) > SAMPLE else order
        found.append(fingerprint(mix(np.sort(least))))
    return found


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, words_key, fps) of rows (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps = [], []
        for text in batch.column(1).to_pylist():
            data = (text or "").encode()
            keys.append(xxhash.xxh3_128_hexdigest(b" ".join(data.lower().split())))
            fps.append(np.array(sampled(shingle_hashes(data, SHINGLE)), np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "words_key", "fps"])

    return rows.mapInArrow(per_slice(work), "doc_id long, words_key string, fps array<long>")


def candidate_pairs(points: DataFrame) -> DataFrame:
    """(a, b), a < b, of points (fp, node) to be verified."""
    size = points.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1")
    met = points.join(size, "fp")
    star = met.where(F.col("n") > ALL_PAIRS).select("node", F.explode(F.array("least", "most")).alias("to"))
    few = size.where(F.col("n") <= ALL_PAIRS).select("fp")
    held = points.join(few, "fp").groupBy("fp").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # ALL_PAIRS at most
    left = held.select("nodes", F.posexplode("nodes").alias("i", "node"))
    every = left.select("node", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("to"))
    both = star.union(every).where("node <> to")
    return both.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes((t or "").encode(), SHINGLE)).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(rows.join(ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(per_slice(work), "node long, own array<long>"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def shingle_counters(rows: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.unique(shingle_hashes((text or "").encode(), SHINGLE))
                np.add.at(total, own >> np.uint64(64 - COUNTERS), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["counter", "n"])

    got = rows.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").cast("int").alias("n"), F.first("counter").cast("int").alias("c")).select("c", "n").toArrow()
    counts = np.zeros(1 << COUNTERS, np.int32)
    counts[got.column("c").to_numpy()] = got.column("n").to_numpy()
    return counts


def prefix_size(n: int) -> int:
    """Of n shingles in a fixed order, how many of the first hold one of any set that is similar enough."""
    return n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0


def prefixes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, size, first): the first shingles of each text in the order of their counters."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # 2**COUNTERS numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, firsts = [], []
        for text in batch.column(1).to_pylist():
            own = np.unique(shingle_hashes((text or "").encode(), SHINGLE))
            order = np.argsort(shared.value[own >> np.uint64(64 - COUNTERS)], kind="stable")
            sizes.append(len(own))
            firsts.append(own[order[: prefix_size(len(own))]].view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["node", "size", "first"])

    return rows.mapInArrow(per_slice(work), "node long, size int, first array<long>")


def _possible(i: np.ndarray, j: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (a, b), a < b, of the places i, j whose texts are not joined and may be similar enough."""
    left = np.minimum(size[i] - at[i], size[j] - at[j])  # as if this were the first shingle they share
    keep = (root[i] != root[j]) & (left >= SIMILARITY / (1 + SIMILARITY) * (size[i] + size[j]) - 1e-6)
    a, b = node[i[keep]], node[j[keep]]
    return np.stack((np.minimum(a, b), np.maximum(a, b)), 1)


def pairs_of_runs(key: np.ndarray, *columns: np.ndarray) -> Iterator[np.ndarray]:
    """Possible pairs within each run of equal keys; `columns`: node, root, size, place in the order."""
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(cuts):
        return
    root = columns[1]
    mixed = np.minimum.reduceat(root, cuts) != np.maximum.reduceat(root, cuts)
    ends = np.append(cuts[1:], len(key))
    small = mixed & (ends - cuts <= ALL_PAIRS)
    own = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(cuts[small], ends[small], strict=True))])
    end = np.repeat(ends[small], (ends - cuts)[small])
    for d in range(1, ALL_PAIRS):
        fits = own + d < end
        own, end = own[fits], end[fits]
        yield _possible(own, own + d, *columns)
    for a, b in zip(cuts[mixed & ~small], ends[mixed & ~small], strict=True):
        roots, n = np.unique(root[a:b], return_counts=True)
        others = a + np.flatnonzero(root[a:b] != roots[n.argmax()])
        step = max(1, AT_ONCE // (b - a))
        for k in range(0, len(others), step):
            i = others[k : k + step]
            yield _possible(np.repeat(i, b - a), np.tile(np.arange(a, b), len(i)), *columns)


def unjoined_pairs(first: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the nodes of `roots` (node, root) with different roots that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for pairs in pairs_of_runs(rows[0], rows[1], rows[2], rows[3] >> 32, rows[3] & 0xFFFFFFFF):
                if len(pairs):
                    pairs = np.unique(pairs, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= AT_ONCE:
                rows = np.concatenate(held, 1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last run may go on
                held = [rows[:, cut:]]
                yield from done(rows[:, :cut])
        if held:
            yield from done(np.concatenate(held, 1))

    placed = first.join(roots, "node").select("node", "root", "size", F.posexplode("first").alias("at", "key"))
    rows = placed.select("key", "node", "root", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")).alias("where"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(node, root) of every document that is a near copy in the group of a smaller one, its root."""
    rows = chosen(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    own = written(sketches(rows))
    heads = written(own.groupBy("words_key").agg(F.min("doc_id").alias("node"), F.min_by("fps", "doc_id").alias("fps")))
    same = own.join(heads.select("words_key", "node"), "words_key").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    points = heads.select(F.explode(F.array_distinct("fps")).alias("fp"), "node")
    pairs = written(candidate_pairs(points))
    alike = verified(pairs, rows).select(F.col("b").alias("u"), F.col("a").alias("v"))
    linked = near_duplicates(rows).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    quick = components(same.union(alike).union(linked))
    roots = written(heads.select("node").distinct().join(quick, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    left = written(unjoined_pairs(prefixes(rows, shingle_counters(rows)), roots))
    rest = verified(left, rows)
    groups = components(quick.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    for done in (own, heads, pairs, roots, left):
        drop_table(done)
    return groups


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is the least of its group; rows without doc_id stay."""
    gone = near_copy_groups(docs).select(F.col("node").alias("doc_id"))
    return without(docs, gone)
