"""Probabilities and ideal code lengths as column expressions; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the models.
ESCAPE = 1e-4
LN5 = math.log(5.0)
T3_Q90 = 1.6377443536962102
SCALES = (0.25, 0.5, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384, 65536, 1048576)
LAPLACE_SCALES = (0.5, 0.7, 0.9, 1.1, 1.4, 1.8, 2.4, 3.2)
T3_SCALES = (0.7, 1.0, 1.4, 2.0)


def laplace_mass(value: Column, centre: Column, scale: Column, floor: float = 1e-3) -> Column:
    """Mass of the unit interval around `value` under a Laplace density."""
    r, b = F.abs(value - centre), F.greatest(scale, F.lit(floor))
    top = F.exp(-(r + 0.5) / b)
    return F.when(r < 0.5, 1 - top).otherwise(0.5 * (F.exp(-F.greatest((r - 0.5) / b, F.lit(0.0))) - top))


def t3_cdf(z: Column) -> Column:
    """Student's t with three degrees of freedom, in closed form."""
    u = z / math.sqrt(3.0)
    return 0.5 + (u / (1 + u * u) + F.atan(u)) / math.pi


def t3_mass(value: Column, centre: Column, scale: Column) -> Column:
    b = F.greatest(scale, F.lit(1e-3))
    return t3_cdf((value + 0.5 - centre) / b) - t3_cdf((value - 0.5 - centre) / b)


def monotone(q: Column) -> Column:
    """Quantiles made ascending by their running maximum."""
    return F.transform(q, lambda v, i: F.array_max(F.slice(q, 1, i + 1)))


def quantile_cdf(q: Column, x: Column) -> Column:
    """Distribution function through nine ascending quantiles: linear between them, exponential tails of mass 0.1."""
    at = lambda i: F.element_at(q, i)
    spread = F.greatest(at(9) - at(1), F.lit(1e-6))
    low, high = F.greatest(at(2) - at(1), spread * 1e-3), F.greatest(at(9) - at(8), spread * 1e-3)
    k = F.size(F.filter(q, lambda v: v <= x))
    mid = k * 0.1 + 0.1 * (x - F.element_at(q, F.greatest(k, F.lit(1)))) / F.greatest(F.element_at(q, F.least(k + 1, F.lit(9))) - F.element_at(q, F.greatest(k, F.lit(1))), F.lit(1e-6))
    f = F.when(k == 0, 0.1 * F.exp((x - at(1)) / low)).when(k == 9, 1 - 0.1 * F.exp(-(x - at(9)) / high)).otherwise(mid)
    return F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))


def quantile_mass(q: Column, x: Column) -> Column:
    return quantile_cdf(q, x + 0.5) - quantile_cdf(q, x - 0.5)


def escaped(p: Column, span: Column) -> Column:
    """A little of a uniform mass over the span, so that nothing is impossible."""
    return (1 - ESCAPE) * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) + ESCAPE / span


def bits(p: Column) -> Column:
    return -F.log2(F.greatest(p, F.lit(1e-300)))


def golomb_bits(v: Column) -> Column:
    """Length of the order-0 exponential Golomb code of v >= 0."""
    return (2 * (F.length(F.bin(v + 1)) - 1) + 1).cast("long")


def order0_bits(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Empirical entropy of `value` and 32 bits for each distinct one; counts are combined before the shuffle."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"), F.count(F.lit(1)).alias("distinct"))
    return total.select(*keys, "n", "distinct", (F.col("n") * F.log2("n") - F.col("s") + 32.0 * F.col("distinct")).alias("bits"))


def serial_width(span: Column) -> Column:
    """Bytes of the narrowest unsigned integer that holds 0..span."""
    return F.when(span < 256, 1).when(span < 65536, 2).when(span < 4294967296, 4).otherwise(8)


def running_mean(rows: DataFrame, value: str, adapt: int, out: str, floor: float = 1e-3, keys=("sid",), init_floor: float | None = None) -> DataFrame:
    """Mean of earlier values with forgetting 1 - 1/adapt, begun with the mean of the first `adapt` values.

    The recursion r[i+1] = r[i] + (v[i] - r[i]) / adapt in closed form: a weighted running sum. Weights grow
    as (1 - 1/adapt)**-i, so the sum restarts from its own carried value every `adapt` * 64 samples."""
    r, block = 1.0 - 1.0 / adapt, adapt * 64
    first = F.avg(F.when(F.col("t") < adapt, F.col(value))).over(Window.partitionBy(*keys))
    start = F.greatest(first, F.lit(floor if init_floor is None else init_floor))
    part = (F.col("t") / block).cast("long")
    inside = Window.partitionBy(*keys, "__b").orderBy("t")
    d = rows.withColumn("__b", part).withColumn("__i", F.col("t") % block).withColumn("__s", start)
    d = d.withColumn("__c", F.sum(F.col(value) * F.pow(F.lit(r), -(F.col("__i") + 1))).over(inside.rowsBetween(Window.unboundedPreceding, -1)) / adapt)
    if_last = F.coalesce(F.col("__c"), F.lit(0.0)) + F.col(value) * F.pow(F.lit(r), -(F.col("__i") + 1)) / adapt
    ends = d.where(F.col("__i") == block - 1).select(*keys, (F.col("__b") + 1).alias("__b"), (F.pow(F.lit(r), F.lit(float(block))) * if_last).alias("__e"))
    # the carried values of the blocks are a few rows for each series: c[b] = e[b] + r**block * c[b-1]
    decay = r**block
    wb = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.withColumn("__l", F.collect_list("__e").over(wb)).select(*keys, "__b", F.aggregate("__l", F.lit(0.0), lambda a, e: a * decay + e).alias("__p"))
    d = d.join(carried, [*keys, "__b"], "left")
    value_now = F.pow(F.lit(r), F.col("t").cast("double")) * F.col("__s") + F.pow(F.lit(r), F.col("__i").cast("double")) * (F.coalesce(F.col("__p"), F.lit(0.0)) + F.coalesce(F.col("__c"), F.lit(0.0)))
    return d.withColumn(out, F.greatest(value_now, F.lit(floor))).drop("__b", "__i", "__s", "__c", "__p")
