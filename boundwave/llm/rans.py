"""Token ids in a binary table of static range-ANS blocks.

One frequency table, counted over all documents, is shared by all blocks. A block holds the ids of
whole documents and decodes alone: symbol i goes to lane i mod K, and all lanes step together as NumPy
arrays. The state of every lane is stored at a few checkpoints, so that parts of a block can be decoded
in parallel, and two checksums cover the payload and the ids.

Layout of a block (little-endian): the header (`HEADER`: magic, version, lanes, ids, words, checkpoints,
crc32 of what follows, crc32 of the ids as uint32), then for each checkpoint its step and its word
position (2 uint32) and its K states (uint64), then the words (uint32) in the order that a decoder reads.
Blocks are BINARY rows of a table that Spark writes: its commit protocol and any Hadoop file system then
hold for them, and lost tasks are written again. Beside each block stand the documents in it, in ascending
doc_id order, the block's number in its part and the part; parts are ranges of doc_id.

Defined results: null and empty texts have the end id alone; null ids sort first; rows with one doc_id
follow each other in order of their ids; no documents give a table without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import chosen, drop_table, partitions, per_slice, shared_dir, table, written

SCALE = 20
LOW = np.uint64(1) << np.uint64(31)
HEADER = struct.Struct("<4sHHIIHII")
MAGIC = b"RANB"
#: Ids after which a block is closed, ids of a lane at least, lanes at most, checkpoints of a block.
BLOCK, PER_LANE, LANES, CHECKPOINTS = 1 << 21, 256, 2048, 2
BLOCK_SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


class Frequencies:
    """Counts scaled to 2**SCALE in sum; every counted symbol keeps 1 at least."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum()
        f = np.maximum((counts * (1 << SCALE)) // max(1, int(total)), counts > 0).astype(np.int64)
        short = (1 << SCALE) - int(f.sum())
        order = np.argsort(-f, kind="stable")
        if total:
            while short:  # the largest give or take what rounding left over
                step = np.sign(short) * np.minimum(abs(short), np.maximum(f[order[0]] // 2, 1))
                f[order[0]] += step
                short -= int(step)
                order = np.argsort(-f, kind="stable")
        self.f = f.astype(np.uint64)
        self.c = (np.cumsum(f) - f).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The symbol of each slot; built where a process decodes."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._symbol

    def __getstate__(self):
        return {"f": self.f, "c": self.c, "_symbol": None}


def encode_block(ids: np.ndarray, q: Frequencies) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // PER_LANE)))
    steps = -(-n // lanes)
    marks = sorted({steps * i // CHECKPOINTS for i in range(CHECKPOINTS)})
    x = np.full(lanes, LOW)
    out, emitted, states = [], 0, {}
    shift, up, low32 = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        m = len(s)
        y, f = x[:m], q.f[s]
        full = y >= (f << shift)
        if full.any():
            words = y[full].astype(np.uint32)
            out.append(words)
            emitted += len(words)
            y = np.where(full, y >> low32, y)
        high, rest = np.divmod(y, f)
        x[:m] = (high << up) + rest + q.c[s]
        if t in marks:
            states[t] = (emitted, x.copy())
    body = b"".join(struct.pack("<II", t, emitted - states[t][0]) + states[t][1].astype("<u8").tobytes() for t in sorted(states))
    if out:
        body += np.concatenate(out[::-1]).astype("<u4").tobytes()
    return HEADER.pack(MAGIC, 1, lanes, n, emitted, len(states), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: bytes, q: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those from checkpoint `first` up to checkpoint `last`."""
    magic, version, lanes, n, n_words, n_marks, crc, crc_ids = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size :]
    if magic != MAGIC or version != 1 or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    size = 8 + 8 * lanes
    marks = [struct.unpack_from("<II", body, i * size) for i in range(n_marks)]
    words = np.frombuffer(body, "<u4", n_words, n_marks * size)
    steps = -(-n // lanes)
    begin, pos = marks[first] if marks else (0, 0)
    stop = steps if last is None or last >= n_marks else marks[last][0]
    x = np.frombuffer(body, "<u8", lanes, first * size + 8).astype(np.uint64) if marks else np.zeros(lanes, np.uint64)
    ids = np.empty(min(n, stop * lanes) - begin * lanes, np.uint32)
    mask, up, low32 = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(begin, stop):
        at = (t - begin) * lanes
        m = min(lanes, n - t * lanes)
        y = x[:m]
        slot = y & mask
        s = q.symbol[slot]
        ids[at : at + m] = s
        y = q.f[s] * (y >> up) + slot - q.c[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << low32) | words[pos : pos + len(need)]
            pos += len(need)
        x[:m] = y
    if first == 0 and stop == steps and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("ids differ from their checksum")
    return ids


def tokenised(docs: DataFrame, path: str, end_id: int, by: str = "library") -> DataFrame:
    """(doc_id, ids): the ids as packed integers of the vocabulary's width, `end_id` behind each text; no shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, by)
        offsets, ids = enc.encode(batch.column(1))
        kind = width(len(enc.names))
        ids = np.insert(ids.astype(kind), offsets[1:], end_id)
        ends = (offsets + np.arange(len(offsets))) * kind.itemsize
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        return pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary())], names=["doc_id", "ids"])

    rows = chosen(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(per_slice(work), "doc_id long, ids binary")


def width(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def counted(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows; a row for each id and task is shuffled, and a number for each id reaches the driver."""
    kind = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            total += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    got = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def write_blocks(tokens: DataFrame, counts: np.ndarray, path: str) -> None:
    """The rows (doc_id, ids) of `tokens` as blocks in ascending doc_id order, and the counts beside them."""
    spark = tokens.sparkSession
    kind, q = width(len(counts)), Frequencies(counts)
    shared = spark.sparkContext.broadcast(q)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, pieces, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(pieces).astype(np.uint32)
            row = [part, block, first, len(ids), docs, sizes, encode_block(ids, shared.value)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "first", "n_ids", "doc_ids", "counts", "payload"])

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind)
                docs.append(doc)
                sizes.append(len(ids))
                pieces.append(ids)
                held += len(ids)
                if held >= BLOCK:
                    yield close()
                    block, first = block + 1, first + held
                    docs, sizes, pieces, held = [], [], [], 0
        if docs:
            yield close()

    ranged = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    seen = np.flatnonzero(counts)
    spark.createDataFrame([(int(i), int(counts[i])) for i in seen], "id int, n long").coalesce(1).write.parquet(f"{path}/counts")
    shared.unpersist()


def read_blocks(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian uint32) of each document, decoded from the blocks."""
    counts = np.zeros(vocabulary, np.int64)
    for r in spark.read.parquet(f"{path}/counts").collect():  # a row for each id of the vocabulary at most
        counts[r["id"]] = r["n"]
    shared = spark.sparkContext.broadcast(Frequencies(counts))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each part
    before, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        before.append((part, at))
        at += n
    starts = dict(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, first = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                sizes = batch.column(3)[r].values.to_numpy()
                ids = decode_block(batch.column(4)[r].as_buffer(), shared.value)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(2)[r].values, pa.array(starts[part] + first + ends[:-1]), pa.array(sizes), data], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "first", "doc_ids", "counts", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_documents(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, by: str = "library") -> int:
    """Encode all texts and write them as blocks; returns the vocabulary's size."""
    tokens = written(tokenised(docs, vocabulary, end_id, by))
    size = len(encoder(vocabulary, by).names)
    write_blocks(tokens, counted(tokens, size), path)
    drop_table(tokens)
    return size


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    size = write_documents(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return read_blocks(spark, path, size).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
