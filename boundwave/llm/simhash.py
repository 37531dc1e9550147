"""SimHash fingerprints and near duplicates by sharded vantage-point trees.

The upper part of the tree deals fingerprints into shards. Each inner node has a vantage fingerprint v and a
radius m: what lies within m of v (whole Hamming distance d) goes left, the rest right. Two fingerprints
within r of each other have distances to v that differ by r at most (the triangle bound), so a pair that
parts at a node has its left one in m - r < d <= m: only these also visit the right side as guests, and a
guest goes on to every side that the bound leaves open. So every pair meets in the shard of its right one,
once. Vantage points and radii are chosen on a sample of the fingerprints (a share of `SHARE`, at most
`SAMPLE`; it decides the shards' sizes, not the result): of a few candidates the one whose distances spread
most, and their median.

A shard continues the tree in memory, down to nodes small enough to compare. It gives links to the least
member of each of its groups, and stars contract these to components. Equal fingerprints are one point,
counted before any shuffle of documents. At radius 2 some two fifths of random fingerprints lie in a node's
border on either side, so visits grow as about the half power of the number of shards; clustered
fingerprints have fewer.

Defined results: null, empty and blank texts have no words and fingerprint zero, which links like any other;
rows without doc_id get a fingerprint and no component; equal doc_ids are one document for the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, per_slice, table, written
from .components import components

#: Fingerprints of a shard, about; the sample's bounds; candidates for a vantage point; pairs compared at once.
SHARD, SHARE, SAMPLE, CANDIDATES, AT_ONCE = 1 << 14, 1 / 16, 1 << 18, 8, 1 << 20


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each `size`-word shingle, repeats included; fewer words: of all; none: empty."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z alone, splits at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; no shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes((t or "").encode(), size)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = chosen(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(per_slice(work), "doc_id long, fp long")


def distance(fp: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(fp ^ vantage).astype(np.int16)


def vantage(fp: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few of the fingerprints the one from which the distances spread most, and a radius with a part on either side; None if they are all one."""
    best = None
    for at in np.linspace(0, len(fp) - 1, min(CANDIDATES, len(fp))).astype(int):
        d = distance(fp, fp[at])
        far = int(d.max())
        if far and (best is None or d.std() > best[0]):
            best = (d.std(), fp[at], min(int(np.median(d)), far - 1))
    return None if best is None else (best[1], best[2])


class Tree:
    """Inner nodes as arrays: vantage point, radius and the two children; a child below 0 is shard -child - 1."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.vantage, self.radius, self.child, self.shards = [], [], [], 0
        self.root = self._grow(np.unique(sample), leaf)
        self.vantage = np.array(self.vantage, np.uint64)
        self.radius = np.array(self.radius, np.int16)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, fp: np.ndarray, leaf: int) -> int:
        top: list[int] = [0]
        todo = [(fp, top, 0)]
        while todo:
            own, holder, side = todo.pop()
            found = vantage(own) if len(own) > leaf else None
            if found is None:
                self.shards += 1
                holder[side] = -self.shards
                continue
            holder[side] = len(self.vantage)
            children = [0, 0]
            self.vantage.append(found[0])
            self.radius.append(found[1])
            self.child.append(children)
            near = distance(own, found[0]) <= found[1]
            todo += [(own[near], children, 0), (own[~near], children, 1)]
        return top[0]

    def route(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, index into fp, whether it is a guest) of every visit."""
        node, at, guest = np.full(len(fp), self.root), np.arange(len(fp)), np.zeros(len(fp), bool)
        done = []
        while True:
            leaf = node < 0
            done.append((-node[leaf] - 1, at[leaf], guest[leaf]))
            node, at, guest = node[~leaf], at[~leaf], guest[~leaf]
            if not len(node):
                return tuple(np.concatenate(x) for x in zip(*done, strict=True))
            d = np.bitwise_count(fp[at] ^ self.vantage[node]).astype(np.int16)
            m = self.radius[node]
            left = np.where(guest, d <= m + radius, d <= m)
            right = d > m - radius
            own = ~guest & (d > m)  # residents of the right side
            node, at, guest = (
                np.concatenate((self.child[node[left], 0], self.child[node[right], 1])),
                np.concatenate((at[left], at[right])),
                np.concatenate((guest[left], ~own[right])),
            )


def shards_of(points: DataFrame, shard: int = SHARD) -> Tree:
    """The tree over points (fp): drawn from a bounded sample, which is chosen by a hash."""
    n = points.count()
    if n <= shard:
        return Tree(np.zeros(0, np.uint64), shard)
    share = min(SHARE, SAMPLE / n)
    few = points.where(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()
    return Tree(few.column(0).to_numpy().view(np.uint64), max(1, int(share * shard)))


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a and b, each group under its least index."""
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def close_pairs(fp: np.ndarray, home: np.ndarray, guest: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (a, b) of all pairs within `radius` of two residents, or of a guest and a resident; a tree in memory."""
    todo = [(home, guest)]
    while todo:
        own, others = todo.pop()
        if not len(own):
            continue
        found = vantage(fp[own]) if len(own) > 64 and len(own) * (len(own) + len(others)) > 1 << 15 else None
        if found is None:
            every = np.concatenate((own, others))
            step = max(1, AT_ONCE // len(own))
            for k in range(0, len(every), step):
                part = every[k : k + step]
                i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[own][None, :]) <= radius)
                yield part[i], own[j]
            continue
        v, m = found
        d, e = distance(fp[own], v), distance(fp[others], v)
        todo.append((own[d <= m], others[e <= m + radius]))
        todo.append((own[d > m], np.concatenate((others[e > m - radius], own[(d <= m) & (d > m - radius)]))))


def shard_links(fp: np.ndarray, guest: np.ndarray, radius: int) -> np.ndarray:
    """For each point of a shard (residents and guests) the least index that it is linked with, by way of others."""
    label = np.arange(len(fp))
    for a, b in close_pairs(fp, np.flatnonzero(~guest), np.flatnonzero(guest), radius):
        apart = label[a] != label[b]
        label = settle(label, a[apart], b[apart])
    return label


def links(points: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect the nodes of `points` (fp long, distinct; node long) as all pairs within `radius` do."""
    tree = points.sparkSession.sparkContext.broadcast(shards_of(points, shard))  # SAMPLE nodes at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in range(0, len(fp), 1 << 14):
                to, at, guest = tree.value.route(fp[k : k + (1 << 14)], radius)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fp[k + at].view(np.int64)), pa.array(node[k + at]), pa.array(guest)], names=["shard", "fp", "node", "guest"])

    def search(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node, kind="stable")  # so the least index is the least node
        fp, guest, node = group.column("fp").to_numpy().view(np.uint64)[order], group.column("guest").to_numpy()[order], node[order]
        label = shard_links(fp, guest, radius)
        own = label != np.arange(len(label))
        return pa.table({"u": node[own], "v": node[label[own]]})

    sent = points.select("fp", "node").mapInArrow(send, "shard long, fp long, node long, guest boolean")
    return sent.groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least doc_id that links of at most `radius` bits reach."""
    marked = written(fingerprints(docs, size))
    points = written(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    twice = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    if not twice.isEmpty():  # a doc_id with several texts joins their fingerprints
        return _by_fingerprint(marked, radius)
    roots = components(links(points, radius))
    return _labelled(marked, points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))


def _labelled(marked: DataFrame, named_points: DataFrame) -> DataFrame:
    joined = marked.join(named_points, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _by_fingerprint(marked: DataFrame, radius: int) -> DataFrame:
    rows = marked.where("doc_id IS NOT NULL").select("doc_id", "fp").distinct()
    points = rows.select("fp").distinct().select("fp", F.col("fp").alias("node"))
    same = rows.join(rows.groupBy("doc_id").agg(F.min("fp").alias("v")), "doc_id").select(F.col("fp").alias("u"), "v").where("u <> v")
    roots = components(links(points, radius).unionByName(same))
    of = rows.join(roots, rows["fp"] == roots["node"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return _labelled(marked, of.select("fp", "root").distinct().join(least, "root").select("fp", "component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
