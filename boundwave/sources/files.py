"""Scans of series from files, and sinks; every scan is a DataFrame read by executors."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import decimal_scale, gap_fill, number


def _stem():
    return F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _binary(spark: SparkSession, path: str, parse, schema: str = "sid string, t long, x double") -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(_stem().alias("sid"), "content")

    def run(batches):
        for batch in batches:
            for sid, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from parse(sid, content.as_buffer())

    return files.mapInArrow(run, schema)


def _rows(sid: str, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"sid": pa.array([sid] * len(x), pa.string()), "t": np.arange(len(x)), "x": np.asarray(x, float)})


def npy(spark: SparkSession, path: str, shortest: bool = True) -> DataFrame:
    """Arrays of one file each, rounded to integers; `shortest`: cut to the length of the shortest."""

    def parse(sid, buffer):
        a = np.atleast_2d(np.load(io.BytesIO(buffer)))
        for g, row in enumerate(a):
            yield _rows(sid if len(a) == 1 else f"{sid}/{g}", np.rint(row))

    found = _binary(spark, path, parse)
    if not shortest:
        return found
    least = found.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    return found.join(F.broadcast(least), F.col("t") < F.col("n")).drop("n")  # one row


def npz(spark: SparkSession, path: str) -> DataFrame:
    """(kind, sid, rho, t, x) of archives with keys kind|sid|rho."""

    def parse(_sid, buffer):
        with np.load(io.BytesIO(buffer)) as held:
            for key in held.files:
                kind, sid, rho = [*key.split("|"), "", ""][:3]
                x = np.ravel(held[key]).astype(float)
                n = len(x)
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.string()), "sid": pa.array([sid] * n, pa.string()), "rho": pa.array([float(rho or "nan")] * n), "t": np.arange(n), "x": x})

    return _binary(spark, path, parse, "kind string, sid string, rho double, t long, x double")


def raw_float32(spark: SparkSession, path: str, start: int = 0, n: int | None = None) -> DataFrame:
    """Values of raw little-endian float32 files, or a slice of them; constant series are left out."""

    def parse(sid, buffer):
        x = np.frombuffer(buffer, "<f4")[start : None if n is None else start + n].astype(float)
        if len(x) and x.std() > 0:
            yield _rows(sid, x)

    return _binary(spark, path, parse)


def plane_rows(width: int, height: int, plane: int, rows: int) -> tuple[int, int]:
    """(start, n) of the first scan lines of one plane of a volume."""
    return plane * width * height, rows * width


def csv_values(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of text files, several to a line in reading order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value").where(F.length(F.trim("value")) > 0)
    cells = lines.select(_stem().alias("sid"), "line", F.posexplode(F.split("value", ",")).alias("i", "v"))
    t = F.row_number().over(Window.partitionBy("sid").orderBy("line", "i")) - 1
    return cells.select("sid", t.cast("long").alias("t"), F.rint(F.trim("v").try_cast("double")).alias("x"))


def grid_load(spark: SparkSession, path: str, least: int = 3000, missing: float = 0.02, span: float = 10.0) -> DataFrame:
    """Hourly demand by balancing authority: the measured column or else the imputed one, gaps filled, short or flat ones left out."""
    raw = spark.read.option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    x = F.coalesce(number(F.col("`Demand (MW)`")), number(F.col("`Demand (MW) (Imputed)`")))
    rows = raw.select(F.col("`Balancing Authority`").alias("sid"), "line", x.alias("x"))
    rows = rows.withColumn("t", (F.row_number().over(Window.partitionBy("sid").orderBy("line")) - 1).cast("long"))
    good = rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x").isNull().cast("int")).alias("gone")).where((F.col("n") >= least) & (F.col("gone") <= missing))
    filled = gap_fill(rows.join(good.select("sid"), "sid", "left_semi").select("sid", "t", "x")).select("sid", "t", F.rint("x").alias("x"))
    wide = filled.groupBy("sid").agg((F.max("x") - F.min("x")).alias("range")).where(F.col("range") >= span)
    return filled.join(wide.select("sid"), "sid", "left_semi")


def transit(spark: SparkSession, path: str) -> DataFrame:
    """Riders by station and hour from JSON records; hours that a station lacks are 0, repeated records add up."""
    raw = spark.read.schema("transit_timestamp string, station_complex_id string, r string").json(path, multiLine=True)
    sums = raw.groupBy(F.col("station_complex_id").alias("sid"), F.col("transit_timestamp").alias("at")).agg(F.sum(F.col("r").try_cast("double")).alias("x"))
    hours = sums.select("at").distinct()
    index = hours.select("at", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("t"))  # a row for each hour
    return sums.select("sid").distinct().crossJoin(index).join(sums, ["sid", "at"], "left").select("sid", "t", F.rint(F.coalesce("x", F.lit(0.0))).alias("x"))


def pageviews(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("items array<struct<views: bigint>>").json(path, multiLine=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode("items").alias("t", "item"))
    return rows.select(_stem().alias("sid"), F.col("t").cast("long").alias("t"), F.col("item.views").cast("double").alias("x"))


def timestamped(spark: SparkSession, path: str) -> DataFrame:
    """CSV of timestamp and value, scaled to integers that keep four digits of the range."""
    raw = spark.read.option("header", True).schema("timestamp string, value double").csv(path).select(F.col("_metadata.file_path").alias("path"), "timestamp", "value")
    t = F.row_number().over(Window.partitionBy("sid").orderBy("timestamp")) - 1
    rows = raw.select(_stem().alias("sid"), "timestamp", F.col("value").alias("x")).select("sid", t.cast("long").alias("t"), "x")
    return decimal_scale(rows).select("sid", "t", F.col("v").cast("double").alias("x"))


def results(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Result files {"a|b|…": {…numbers…}} as rows: the parts of the key as `names`, then key and value."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    rows = raw.select(F.explode("m").alias("key", "held")).select("key", F.explode("held").alias("metric", "value"))
    return rows.select(*(F.split_part("key", F.lit("|"), F.lit(i + 1)).alias(c) for i, c in enumerate(names)), "metric", "value")


def containers(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, blob) of container files."""
    return spark.read.format("binaryFile").load(path).select(_stem().alias("group_id"), F.col("content").alias("blob"))


def write_npy(series: DataFrame, path: str) -> None:
    """Packed series (sid, n, npy binary), one row for each, written by Spark."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        held = io.BytesIO()
        np.save(held, group.column("x").to_numpy())
        return pa.table({"sid": [group.column("sid")[0].as_py()], "n": [group.num_rows], "npy": [held.getvalue()]})

    series.select("sid", "t", "x").groupBy("sid").applyInArrow(pack, "sid string, n long, npy binary").write.mode("overwrite").parquet(path)


def write_cache(indices: DataFrame, path: str) -> None:
    """Indices partitioned by what later scans filter on."""
    indices.write.mode("overwrite").partitionBy("rho").parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    """A table of rows in Markdown, in the order of the rows' first column."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "k int, value string")
    body = rows.select(F.lit(2).alias("k"), line.alias("value"))
    head.union(body).orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
