"""Substring dedup: repeated-phrase automata.

A passage of `span` words that two texts share holds the same least `phrase`-word run, so it is enough to
look for runs that are least in some window (winnowing): about one word in thirteen starts one. Runs found
in two different texts are confirmed phrases. A phrase is known by its hash and, in every shard of documents
that has it among its least runs (the shard's sieve), by one place to read its words from. Each shard
compiles the phrases it was sent into Aho-Corasick automata of bounded size, on words as single letters, and
streams all of its documents through them: the automata alone say where phrases occur. The `span`-word windows
over these occurrences, and only these, are compared: they meet in the sorted stream of `firsts`, which
returns the ones a smaller document holds too.

Phrases and documents of a shard are bounded by the shard, and a phrase of many documents is one row for each
shard, so no phrase is a hot key. Exact copies of a whole text are recognised by a 128-bit hash and take no
part in the comparison: the smallest document of each text stands for all.

Defined results: null, empty and blank texts have no words; texts shorter than `span` words are never
changed; rows without doc_id are kept whole and count for nobody; rows with one doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, drop_table, hex_sha256, partitions, per_slice, runs_of, table, word_hashes, words_of, written
from .firsts import later_occurrences

SPAN, PHRASE = 50, 25
SHARD_BYTES = 4 << 20
#: Letters an automaton can tell apart: all code points but surrogates and zero.
LETTERS = 0x110000 - 0x800 - 1
_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def least_runs(h: np.ndarray, offsets: np.ndarray, span: int = SPAN, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the runs of `phrase` words that are least in some window of `span` words of one text."""
    wide = span - phrase + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = runs_of(h, phrase)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = _sliding(np.minimum, runs, wide)[:n]
    least = np.where(owner[:n] == owner[span - 1 :], least, 0)  # windows over two texts count for nothing
    pad = np.zeros(wide - 1, np.uint64)
    most = _sliding(np.maximum, np.concatenate((pad, least, pad)), wide)
    at = np.flatnonzero((most[: len(runs)] == runs[: len(most)]) & (runs[: len(most)] > 0))
    return at, runs[at]


def _sliding(of: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """of(x[i:i + size]) for each i, by doubling."""
    width = 1
    while width * 2 <= size:
        x = of(x[:-width], x[width:])
        width *= 2
    return x if width == size else of(x[: len(x) - (size - width)], x[size - width :])


def anchors(rows: DataFrame) -> DataFrame:
    """(run, text_key, shard, doc_id, at): the distinct least runs of each row, with the word each starts at."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, words = words_of(batch.column(0))
        at, runs = least_runs(word_hashes(words), offsets)
        doc = np.searchsorted(offsets, at, side="right") - 1
        order = np.lexsort((at, runs, doc))
        doc, runs, at = doc[order], runs[order], at[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1])
        doc, at = doc[new], at[new] - offsets[doc[new]]
        row = pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(runs[new].view(np.int64)), *(batch.column(i).take(row) for i in (1, 2, 3)), pa.array(at, pa.int32())], names=["run", "text_key", "shard", "doc_id", "at"])

    return rows.select("text", "text_key", "shard", "doc_id").mapInArrow(per_slice(work), "run long, text_key long, shard int, doc_id long, at int")


def automata(codes: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[ahocorasick.Automaton, np.ndarray]]:
    """Automata for the distinct runs codes[s:s + size], s in `starts`, each with the letter of every word code (0: in no run)."""
    window = codes[starts[:, None] + np.arange(size)[None, :]]
    at = 0
    while at < len(window):
        stop = min(len(window), at + LETTERS // size)
        used = np.unique(window[at:stop])
        letter = np.zeros(int(codes.max()) + 1, np.uint32)
        letter[used] = np.arange(1, len(used) + 1)
        letter[letter >= 0xD800] += 0x800
        found = ahocorasick.Automaton()
        for row in letter[window[at:stop]]:
            found.add_word(row.astype("<u4").tobytes().decode("utf-32-le"), 0)
        found.make_automaton()
        yield found, letter
        at = stop


def occurrences(codes: np.ndarray, offsets: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Start of every occurrence in the texts of the runs that begin at `starts`."""
    found = []
    if len(starts):
        for automaton, letter in automata(codes, starts, size):
            text = letter[codes].astype("<u4").tobytes().decode("utf-32-le")
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a >= size:
                    found.extend([end - size + 1 for end, _ in automaton.iter(text, a, b)])
    return np.unique(np.array(found, np.int64))


def shard_windows(docs: pa.Table, sent: pa.Table) -> pa.Table:
    """(h1, h2, doc_id, text_key, at) of the windows of one shard's documents that hold a phrase.

    `sent`: for each phrase (run) a place (doc_id, text_key, at); without a run: copies, which are left out."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("h1", "h2", "doc_id", "text_key", "at")})
    ids, keys = docs.column("doc_id").to_numpy(), docs.column("text_key").to_numpy()
    runs = sent.column("run").is_valid().to_numpy()
    from_doc, from_key = sent.column("doc_id").to_numpy(), sent.column("text_key").to_numpy()
    copies = set(zip(from_doc[~runs].tolist(), from_key[~runs].tolist(), strict=True))
    keep = np.fromiter((pair not in copies for pair in zip(ids.tolist(), keys.tolist(), strict=True)), bool, len(ids))
    if not runs.any() or not keep.any():
        return empty
    # the places of phrases may be in documents that are copies of others: these are read, but not compared
    offsets, words = words_of(docs.column("text").combine_chunks())
    packed = words.dictionary_encode()
    distinct, codes = packed.dictionary.to_pylist(), packed.indices.to_numpy()
    row_of = {pair: i for i, pair in enumerate(zip(ids.tolist(), keys.tolist(), strict=True))}
    rows = np.fromiter((row_of[pair] for pair in zip(from_doc[runs].tolist(), from_key[runs].tolist(), strict=True)), np.int64, int(runs.sum()))
    places = offsets[rows] + sent.column("at").to_numpy()[runs].astype(np.int64)
    at = occurrences(codes, offsets, places, PHRASE)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    doc = owner[at]
    at, doc = at[keep[doc]], doc[keep[doc]]
    low, high = np.maximum(offsets[doc], at + PHRASE - SPAN), np.minimum(at, offsets[doc + 1] - SPAN)
    fits = low <= high
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, low[fits], 1)
    np.add.at(cover, high[fits] + 1, -1)
    window = np.flatnonzero(np.cumsum(cover) > 0)
    if not len(window):
        return empty
    wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").astype(np.uint64).reshape(-1, 2)
    h1, h2 = runs_of(wide[codes, 0], SPAN), runs_of(wide[codes, 1], SPAN, 0xD6E8FEB86659FD93)
    doc = owner[window]
    return pa.table({"h1": h1[window].view(np.int64), "h2": h2[window].view(np.int64), "doc_id": ids[doc], "text_key": keys[doc], "at": window - offsets[doc]})


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, ats, whole): where windows start that a smaller document holds too; whole: the text itself does."""
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "text_key")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    second = F.conv(F.substring(F.md5("text"), 1, 16), 16, -10).cast("long")
    ids = written(rows.where("text IS NOT NULL").select(F.col("text_key").alias("h1"), second.alias("h2"), "doc_id", "text_key", "shard"))
    copies = written(later_occurrences(ids, ["text_key", "shard"]).distinct())  # one text may be on a third of all rows
    # one row for each shard and run before runs meet, so a run of many documents has as many rows as there are shards at most
    place = F.struct("doc_id", "text_key", "at")
    found = written(anchors(rows).groupBy("run", "shard").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.min(place).alias("place")))
    confirmed = found.groupBy("run").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("run")
    phrases = found.join(confirmed, "run", "left_semi").select("shard", "run", "place.*")
    sent = written(phrases.unionByName(copies.select("shard", "doc_id", "text_key"), allowMissingColumns=True))
    windows = written(rows.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(shard_windows, "h1 long, h2 long, doc_id long, text_key long, at long"))
    later = written(later_occurrences(windows, ["text_key", "at"]))
    for done in (ids, found, sent, windows):
        drop_table(done)
    of_doc = later.groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("ats"))  # at most the document's own words
    whole = copies.select("doc_id", "text_key", F.lit(True).alias("whole"))
    return of_doc.join(whole, ["doc_id", "text_key"], "full_outer")


@F.arrow_udf(_KEPT)
def kept_words(text: pa.Array, ats: pa.Array, whole: pa.Array) -> pa.Array:
    from .common import slices

    parts = [_kept(text.slice(a, b - a), ats.slice(a, b - a), whole.slice(a, b - a)) for a, b in slices(text)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))


def _kept(text: pa.Array, ats: pa.Array, whole: pa.Array) -> pa.StructArray:
    offsets, words = words_of(text)
    counts = np.diff(offsets)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in range(len(text)):
        if whole[i].is_valid and counts[i] >= SPAN:
            cover[offsets[i]] += 1
            cover[offsets[i + 1]] -= 1
        elif ats[i].is_valid:
            at = offsets[i] + ats[i].values.to_numpy()
            np.add.at(cover, at, 1)
            np.add.at(cover, at + SPAN, -1)
    keep = np.cumsum(cover[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(keep)))[offsets]
    kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep)))
    return pa.StructArray.from_arrays([pc.binary_join(kept, pa.scalar(" ", words.type)).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(counts - np.diff(left), pa.int64())], ["text", "n_words", "n_removed"])


def dedup_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, what is left of each text's words (joined by one space), n_words and n_removed."""
    rows = chosen(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))
    joined = rows.join(repeated_windows(rows), ["doc_id", "text_key"], "left").withColumn("k", kept_words("text", "ats", "whole"))
    return joined.select("doc_id", F.col("k.text").alias("kept"), "k.n_words", "k.n_removed")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_phrases(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))
