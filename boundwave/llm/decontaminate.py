"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts and items are compared as words (lower-cased, marks at both ends taken off) in five-word shingles.
A window of an item's own length can only be similar if it holds one of its shingles, so windows are laid
over every place where a shingle of any item occurs, at every offset; a document shorter than the item is one
window, compared with all items of that length. Each other window gets a SimHash; the index
cuts fingerprints into `BLOCKS` blocks. Of two fingerprints within RADIUS one block at least differs in
RADIUS // BLOCKS bits at most, so the values within that distance are looked up in each block, and all items
found are tested on the whole fingerprint. Pairs are then verified: the shingles' weighted Jaccard similarity
(weight: how often a shingle occurs) must be `SIMILARITY` or more.

The benchmark is a reference set: it is dealt by a hash into blocks of about `BLOCK_BYTES`; one at a time is
sent to the workers, run against all documents and written, and then released, so neither the driver nor an
executor holds more of it. Documents are not shuffled, but for the best match of each pair.

Defined results: null and empty texts match nothing; items without words are ignored; items of fewer than
five words are one shingle; repeated rows give one match for each doc_id and item; rows without doc_id may
match under a null doc_id; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen, mix, per_slice, runs_of, table, words_of, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
BLOCK_BYTES = 16 << 20
#: Comparisons of block values, and windows, at once.
AT_ONCE, PART = 1 << 20, 1 << 16
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¡¿"
SCHEMA = "item_id long, start long, n_words long, similarity double"


def normal_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hash of each word, its place among the text's words) after lower-casing and taking marks off; bare marks are no words."""
    offsets, words = words_of(pc.utf8_lower(texts))
    if not len(words):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = words.dictionary_encode()
    bare = [w.strip(MARKS) for w in packed.dictionary.to_pylist()]
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in bare), np.uint64, len(bare))
    h = own[packed.indices.to_numpy()]
    full = np.flatnonzero(h)
    place = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.searchsorted(full, offsets), h[full], place[full]


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle."""
    return np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each `size` consecutive shingles."""
    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(shingles), axis=0)))
    return np.packbits(total[size:] - total[:-size] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def stretches(places: np.ndarray, reach: int, last: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) of the windows that begin up to `reach` before one of the places, at `last` at the latest; no longer than PART each."""
    places = np.unique(places)
    low, high = np.maximum(places - reach, 0), np.minimum(places, last) + 1
    fits = low < high
    low, high = low[fits], high[fits]
    if not len(low):
        return []
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    ends = high[np.append(new[1:], len(high)) - 1]
    return [(k, min(k + PART, int(b))) for a, b in zip(low[new].tolist(), ends, strict=True) for k in range(a, int(b), PART)]


class Items:
    """One block of the benchmark: its shingles, and an index of fingerprints for each length of item."""

    def __init__(self, rows: list[tuple[int, str]]):
        offsets, h, _ = normal_hashes(pa.array([t for _, t in rows], pa.string()))
        self.ids, self.sizes, self.shingles, self.weights = [], [], [], []
        for i, (item, _) in enumerate(rows):
            words = h[offsets[i] : offsets[i + 1]]
            if len(words):
                own = runs_of(words, min(SHINGLE, len(words)))
                self.ids.append(item)
                self.sizes.append(len(words))
                self.shingles.append(own)
                self.weights.append(Counter(own.tolist()))
        self.short = sorted({n for n in self.sizes if n < SHINGLE})
        self.gates = {}
        for size in [*self.short, SHINGLE]:
            post = defaultdict(set)
            for n, own in zip(self.sizes, self.shingles, strict=True):
                if (n if n < SHINGLE else SHINGLE) == size:
                    for s in own.tolist():
                        post[s].add(n)
            sieve = np.zeros(1 << 20, bool)
            keys = np.array(sorted(post), np.uint64)
            sieve[keys >> np.uint64(44)] = True
            self.gates[size] = (keys, sieve, post)
        cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.prints = np.array([simhashes(own, len(own))[0] for own in self.shingles], np.uint64)
        #: by item length and block: the distinct values, in order, and the items of each
        self.index: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}
        sizes = np.array(self.sizes, np.int64)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            self.index[n] = []
            for shift, mask in self.blocks:
                values, at = np.unique((self.prints[own] >> shift) & mask, return_inverse=True)
                self.index[n].append((values, np.split(own[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))[:-1])))

    def near(self, prints: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(window, item of n words) of all fingerprints within RADIUS; windows are taken in parts of bounded size."""
        step = max(1, AT_ONCE // max(len(values) for values, _ in self.index[n]))
        for k in range(0, len(prints), step):
            part, seen = prints[k : k + step], set()
            for (shift, mask), (values, items) in zip(self.blocks, self.index[n], strict=True):
                window, place = np.nonzero(np.bitwise_count(((part >> shift) & mask)[:, None] ^ values[None, :]) <= RADIUS // BLOCKS)
                for p in np.unique(place):
                    at = window[place == p]
                    for item in items[p].tolist():
                        close = at[np.bitwise_count(part[at] ^ self.prints[item]) <= RADIUS]
                        seen.update((int(w) + k, item) for w in close)
            yield from sorted(seen)

    def holding(self, own: np.ndarray, n: int, size: int) -> list[int]:
        """Items of n words of which the shingles `own` may hold enough."""
        least = SIMILARITY * (n - size + 1) - 1e-9
        if len(own) < least:
            return []
        items = np.flatnonzero(np.array(self.sizes) == n)
        return [int(i) for i in items if np.isin(self.shingles[i], own).sum() >= least]

    def matches(self, words: np.ndarray, hits: dict[int, np.ndarray]) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word) of the best window; `hits`: places of items' shingles, by shingle size."""
        wanted: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for size, places in hits.items():
            post = self.gates[size][2]
            shingles, at = np.unique(runs_of(words, size)[places], return_inverse=True)
            for i, shingle in enumerate(shingles.tolist()):
                for n in post[shingle]:
                    wanted[size, n].append(places[at == i])
        best: dict[int, tuple[float, int]] = {}
        for (size, n), places in wanted.items():
            own = runs_of(words, size)
            if len(words) < n:  # one window over the whole document
                for item in self.holding(own, n, size):
                    s = similarity(Counter(own.tolist()), self.weights[item])
                    if s >= SIMILARITY and (item not in best or s > best[item][0]):
                        best[item] = (s, 0)
                continue
            count = n - size + 1
            for first, end in stretches(np.concatenate(places), n - size, len(words) - n):
                prints = simhashes(own[first : end + count - 1], count)
                for w, item in self.near(prints, n):
                    at = first + w
                    s = similarity(Counter(own[at : at + count].tolist()), self.weights[item])
                    if s >= SIMILARITY and (item not in best or s > best[item][0]):
                        best[item] = (s, at)
        return best

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        offsets, h, place = normal_hashes(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        hits: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for size, (keys, sieve, _) in self.gates.items():
            if not len(keys) or len(h) < size:
                continue
            own = runs_of(h, size)
            at = np.flatnonzero(sieve[own >> np.uint64(44)])
            at = at[keys[np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)] == own[at]]
            at = at[owner[at] == owner[at + size - 1]]
            for d in np.unique(owner[at]):
                hits[int(d)][size] = at[owner[at] == d] - offsets[d]
        rows = []
        for d, places in sorted(hits.items()):
            for item, (s, at) in self.matches(h[offsets[d] : offsets[d + 1]], places).items():
                first = int(place[offsets[d] + at])
                end = min(offsets[d] + at + self.sizes[item], offsets[d + 1])
                rows.append((d, self.ids[item], first, int(place[end - 1]) - first + 1, s))
        d, item, start, n, s = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(d, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())],
            names=["doc_id", "item_id", "start", "n_words", "similarity"],
        )


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, dealt by a hash into blocks of about `limit` bytes; one block at a time is on the driver."""
    items = chosen(benchmark, "item_id", "text").where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // limit)
    for i in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toArrow()
        if got.num_rows:
            order = got.sort_by([("item_id", "ascending"), ("text", "ascending")])
            yield list(zip(order.column(0).to_pylist(), order.column(1).to_pylist(), strict=True))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best match of each document and item it holds."""
    spark = docs.sparkSession
    rows = chosen(docs, "doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words")).alias("b")
    found = []
    for block in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(Items(block))  # BLOCK_BYTES of text
        matches = rows.mapInArrow(per_slice(lambda batch, shared=shared: shared.value.scan(batch)), schema)
        found.append(written(matches.groupBy("doc_id", "item_id").agg(best)))  # an item is in one block, but for repeated ids
        shared.destroy()
    if not found:
        return spark.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, found)
    every = every.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return every.select("doc_id", "item_id", (-F.col("b.start")).alias("start"), "b.n_words", "b.similarity")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
