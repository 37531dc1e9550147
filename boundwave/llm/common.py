"""Helpers shared by the text operators: shared storage, Arrow slices, column handling."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is in every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SLICE_BYTES = 3 << 20
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES:
        df = df.repartition(cores)  # a small table in few files would keep most cores idle
    return df


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one text can be long, and let shuffle files go when their query has ended; a user's own setting stands."""
    for name, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        if spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, value)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes at the driver's end at the latest.

    Where that is unset, a local folder serves a local master; on a cluster it is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="boundwave-")
        root = _OWN[context.applicationId]
    name = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path.getParent())
    system.deleteOnExit(path)
    return name


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: computed once, lineage cut, readable after an executor is lost."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of `written` that is no longer needed."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, …: no name of the caller's can clash with one of an operator's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, column: str) -> str:
    """The name of `column` in flat(df): the exact one, else one that differs in case alone."""
    names = df.columns
    if column in names:
        return f"c{names.index(column)}"
    return f"c{[n.lower() for n in names].index(column.lower())}"


def chosen(df: DataFrame, *same: str, **named: str) -> DataFrame:
    """Only these columns, under their own or the given names."""
    rows = flat(df)
    return rows.select(*(F.col(place(df, column)).alias(alias) for alias, column in (dict(zip(same, same, strict=True)) | named).items()))


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `df` whose doc_id is not among those of `gone` (doc_id); rows with a null one stay."""
    gone = gone.select(F.col("doc_id").alias("gone"))
    return flat(df).join(gone, F.col(place(df, "doc_id")) == F.col("gone"), "left_anti").toDF(*df.columns)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive rows that hold about `limit` bytes of text, one row at least."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("f8"))
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0.0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, stop
        at = stop


def per_slice(work: Callable[..., pa.RecordBatch], column: str = "text"):
    """A mapInArrow function that runs `work` on slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for start, stop in slices(texts):
                out = work(batch.slice(start, stop - start))
                if out is not None and out.num_rows:
                    yield out
        trim()

    return run


def trim() -> None:
    """Give memory that is free back to the system, as Python workers live on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): text i has words[offsets[i]:offsets[i + 1]], split at ASCII white space; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    counts = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))))
    offsets = counts[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return offsets, words.filter(full)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each unsigned integer over the whole word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hex_sha256(column):
    return F.sha2(column, 256)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts as UTF-8; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for empty ranges."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH3-64 of each word; each distinct word is hashed once."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.uint64)
    packed = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w) for w in packed.dictionary.to_pylist()), np.uint64, len(packed.dictionary))
    return own[packed.indices.to_numpy()]


def runs_of(hashes: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each `size` consecutive elements (by doubling, so about log2(size) passes); shorter input has none."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    done, have, part, width, at = None, 0, hashes.astype(np.uint64), 1, size
    power = factor % (1 << 64)
    while at:  # binary powers: `part` covers `width` elements
        if at & 1:
            if done is None:
                done, have = part, width
            else:
                n = min(len(done), len(part) - have)
                done = done[:n] * np.uint64(power) + part[have : have + n]
                have += width
        at >>= 1
        if at:
            n = len(part) - width
            part = part[:n] * np.uint64(power) + part[width:]
            width, power = width * 2, power * power % (1 << 64)
    return mix(done[: len(hashes) - size + 1])
