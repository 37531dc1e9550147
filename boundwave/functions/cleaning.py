"""Preparation of raw series, all as window or aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number with thousands separators; blank and NA are missing."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(~F.upper(bare).isin("", "NA"), bare).try_cast("double")


def gap_fill(series: DataFrame) -> DataFrame:
    """Missing x (null or NaN) by linear interpolation in t; the ends take the nearest value."""
    x = F.when(~F.isnan("x"), F.col("x"))
    seen = Window.partitionBy("sid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("sid").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)  # frames that only grow: a row is looked at once
    known = F.when(x.isNotNull(), F.struct("t", x.alias("x")))
    rows = series.select("sid", "t", F.last(known, True).over(seen).alias("a"), F.last(known, True).over(back).alias("b"))
    between = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    value = F.when(F.col("a").isNull(), F.col("b.x")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col("a.x")).otherwise(between)
    return rows.select("sid", "t", value.alias("x"))


def level_quantize(series: DataFrame, levels: int) -> DataFrame:
    """x on `levels` equal steps between the least and greatest of its series; a constant series is 0."""
    w = Window.partitionBy("sid")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    return series.select("sid", "t", F.when(hi > lo, F.rint((F.col("x") - lo) / (hi - lo) * (levels - 1))).otherwise(0.0).cast("long").alias("level"))


def decimal_scale(series: DataFrame) -> DataFrame:
    """Integers that keep four digits of the range: x times a power of ten, rounded half to even."""
    w = Window.partitionBy("sid")
    span = F.greatest(F.max("x").over(w) - F.min("x").over(w), F.lit(1e-9))
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.lit(4) - F.floor(F.log10(span))))
    return series.select("sid", "t", scale.alias("scale"), F.rint(F.col("x") * scale).cast("long").alias("v"))


def busiest(series: DataFrame, share: float, mass: float, k: int) -> DataFrame:
    """The k series of largest sum among those with values above 0 in more than `share` of samples and more than `mass` in sum."""
    stats = series.groupBy("sid").agg(F.avg((F.col("x") > 0).cast("int")).alias("density"), F.sum("x").alias("total"))
    return stats.where((F.col("density") > share) & (F.col("total") > mass)).orderBy(F.desc("total"), F.desc("sid")).limit(k)


def long_enough(series: DataFrame, start: int, n: int) -> DataFrame:
    """Samples start..start + n - 1 of the series that have them all, counted from 0 again."""
    size = F.count(F.lit(1)).over(Window.partitionBy("sid"))
    rows = series.withColumn("size", size).where((F.col("size") >= start + n) & F.col("t").between(start, start + n - 1))
    return rows.select("sid", (F.col("t") - start).alias("t"), "x")


def strided(series: DataFrame, step: int) -> DataFrame:
    return series.where(F.col("t") % step == 0)
