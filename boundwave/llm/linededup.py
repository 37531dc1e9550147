"""Line dedup: the first document keeps a line, all others lose it; the result is a bitmap for each document.

Keys of lines (stripped of ASCII white space, A-Z lowered, `LEAST` code points at least) are hashed to 128
bits and meet in the sorted stream of `firsts`, one row for each line, sorted by key, document and position.
What leaves the stream are line numbers, packed to compressed keep bitmaps; texts are shuffled once, to meet their bitmaps.

Defined results: null and empty texts are one empty line and stay as they are (null becomes empty);
rows without doc_id keep all lines and count for nobody; rows with one doc_id are one document; repeated
rows lose the same lines; other columns are passed on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, drop_table, flat, hex_sha256, per_slice, place, table, written
from .firsts import later_occurrences

LEAST = 10
_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
_SPACE = SPACE.encode()


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(_SPACE).lower()  # bytes: lowers A-Z alone
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, row_key, line): a row for each line that has a key."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, lines = [], [], []
        for text in batch.column(1).to_pylist():
            before = len(lines)
            for i, line in enumerate((text or "").encode().split(b"\n")):
                if (key := line_key(line, least)) is not None:
                    digests.append(xxhash.xxh3_128_digest(key))
                    lines.append(i)
            sizes.append(len(lines) - before)
        h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(row), batch.column(2).take(row), pa.array(lines, pa.int32())], names=["h1", "h2", "doc_id", "row_key", "line"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "row_key").mapInArrow(per_slice(work), "h1 long, h2 long, doc_id long, row_key long, line int")


def packed(lines: np.ndarray) -> bytes:
    """A compressed bitmap: bit i is 0 if line i goes; lines beyond its end stay."""
    keep = np.ones(int(lines.max()) + 1, bool)
    keep[lines] = False
    return zlib.compress(len(keep).to_bytes(4, "little") + np.packbits(keep).tobytes(), 1)


def unpacked(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap is not None:
        data = zlib.decompress(bitmap)
        size = int.from_bytes(data[:4], "little")
        keep[:size] = np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=size).astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row_key, bitmap) of each row of (doc_id, text, row_key) that loses lines."""
    keys = written(line_keys(docs, least))
    later = later_occurrences(keys, ["row_key", "line"], "line")
    drop_table(keys)

    @F.arrow_udf("binary")
    def pack(lines: pa.Array) -> pa.Array:
        return pa.array([packed(x.values.to_numpy()) for x in lines], pa.binary())

    of_row = later.groupBy("doc_id", "row_key").agg(F.collect_set("line").alias("lines"))  # at most the row's own lines
    return of_row.select("doc_id", "row_key", pack("lines").alias("bitmap"))


@F.arrow_udf(_KEPT)
def kept_lines(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    texts, counts, dropped = [], [], []
    for t, b in zip(text.to_pylist(), bitmap.to_pylist(), strict=True):
        lines = (t or "").split("\n")
        keep = unpacked(b, len(lines))
        texts.append("\n".join([x for x, k in zip(lines, keep, strict=True) if k]) if b is not None else t or "")
        counts.append(len(lines))
        dropped.append(len(lines) - int(keep.sum()))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of `docs` with what is left of their texts, under "kept", and the counts n_lines and n_dropped."""
    rows = flat(docs)
    rows = rows.select(F.col(place(docs, "doc_id")).cast("long").alias("doc_id"), F.col(place(docs, "text")).alias("text"), F.struct(*rows.columns).alias("rest"))
    rows = rows.withColumn("row_key", F.xxhash64("text"))
    joined = rows.join(keep_bitmaps(rows, least), ["doc_id", "row_key"], "left")
    done = joined.withColumn("k", kept_lines("text", "bitmap"))
    return done.select("doc_id", F.col("k.text").alias("kept"), "k.n_lines", "k.n_dropped", "rest")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("kept")).alias("kept_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(f.first_doc < k.doc_id, false) AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
