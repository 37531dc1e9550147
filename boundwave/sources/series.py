"""Series views (sid, t, x) over the driver's tables: dense, zero-filled, regular in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dense(rows: DataFrame, step: str) -> DataFrame:
    """(sid, t, x) of rows (sid, at, v): sums by interval of `step`, 0 where a series has none.

    The spine is one row for each interval and series, so its size follows from the time range alone."""
    sums = rows.groupBy("sid", "at").agg(F.sum("v").alias("v"))
    ends = rows.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.posexplode(F.sequence("a", "b", F.expr(f"interval 1 {step}"))).alias("t", "at"))
    every = rows.select("sid").distinct().crossJoin(spine)
    return every.join(sums, ["sid", "at"], "left").select("sid", F.col("t").cast("long").alias("t"), F.rint(F.coalesce(F.col("v"), F.lit(0)).cast("double")).alias("x"))


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of lines shipped, by day and return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sid"), F.to_date("l_shipdate").alias("at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    return dense(rows, "day")


def supplier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of lines shipped, by day and supplier: the number of series grows with the data."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("sid"), F.to_date("l_shipdate").alias("at"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    return dense(rows, "day")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of orders, by day and priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sid"), F.to_date("o_orderdate").alias("at"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return dense(rows, "day")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events, by hour and type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sid"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("at"), F.lit(1).alias("v"))
    return dense(rows, "hour")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events in hundredths, by type, in order of time and event."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sid"), "ts", "event_id", "value")
    at = F.row_number().over(Window.partitionBy("sid").orderBy("ts", "event_id")) - 1
    return rows.select("sid", at.cast("long").alias("t"), F.rint(F.col("value") * 100).alias("x"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a short series."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sid"), F.posexplode("embedding").alias("t", "v"))
    return rows.select("sid", F.col("t").cast("long").alias("t"), F.rint(F.col("v").cast("double") * 10000).alias("x"))


REVENUE_SQL = """rev_raw AS (
  SELECT l_returnflag AS sid, cast(l_shipdate AS date) AS day, sum(cast(l_extendedprice AS decimal(18,2))) AS v FROM lineitem GROUP BY 1, 2
), rev_ends AS (SELECT min(day) AS a, max(day) AS b FROM rev_raw
), rev_spine AS (SELECT cast(unnest(generate_series(a, b, interval 1 day)) AS date) AS day, a FROM rev_ends
), series AS (
  SELECT s.sid, cast(p.day - p.a AS bigint) AS t, round_even(cast(coalesce(r.v, 0) AS double), 0) AS x
  FROM (SELECT DISTINCT sid FROM rev_raw) s CROSS JOIN rev_spine p LEFT JOIN rev_raw r ON r.sid = s.sid AND r.day = p.day
)"""
SUPPLIER_SQL = REVENUE_SQL.replace("l_returnflag AS sid", "cast(l_suppkey AS varchar) AS sid")
ORDERS_SQL = """ord_raw AS (
  SELECT o_orderpriority AS sid, cast(o_orderdate AS date) AS day, sum(cast(o_totalprice AS decimal(18,2))) AS v FROM orders GROUP BY 1, 2
), ord_ends AS (SELECT min(day) AS a, max(day) AS b FROM ord_raw
), ord_spine AS (SELECT cast(unnest(generate_series(a, b, interval 1 day)) AS date) AS day, a FROM ord_ends
), series AS (
  SELECT s.sid, cast(p.day - p.a AS bigint) AS t, round_even(cast(coalesce(r.v, 0) AS double), 0) AS x
  FROM (SELECT DISTINCT sid FROM ord_raw) s CROSS JOIN ord_spine p LEFT JOIN ord_raw r ON r.sid = s.sid AND r.day = p.day
)"""
EVENTS_SQL = """evt_raw AS (
  SELECT event_type AS sid, date_trunc('hour', ts) AS hour, count(*) AS v FROM events GROUP BY 1, 2
), evt_ends AS (SELECT min(hour) AS a, max(hour) AS b FROM evt_raw
), evt_spine AS (SELECT unnest(generate_series(a, b, interval 1 hour)) AS hour, a FROM evt_ends
), series AS (
  SELECT s.sid, cast(epoch(p.hour - p.a) / 3600 AS bigint) AS t, cast(coalesce(r.v, 0) AS double) AS x
  FROM (SELECT DISTINCT sid FROM evt_raw) s CROSS JOIN evt_spine p LEFT JOIN evt_raw r ON r.sid = s.sid AND r.hour = p.hour
)"""
EMBEDDING_SQL = """emb_raw AS (SELECT cast(vec_id AS varchar) AS sid, unnest(embedding) AS v, unnest(range(len(embedding))) AS t FROM embeddings
), series AS (SELECT sid, cast(t AS bigint) AS t, round_even(cast(v AS double) * 10000, 0) AS x FROM emb_raw)"""
