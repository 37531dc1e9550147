"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours; partial minima are taken before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u long, v long) but the roots; root is the least node of the component.

    Each round replaces an edge by one to a smaller node, as stars: first from the larger neighbours, then
    from the smaller ones. The rounds end when the set of edges stays as it is; their number grows with
    the logarithm of the longest path. No group is collected and nothing but two numbers reaches the driver.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _with_least(down)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(new)
        drop_table(now)
        now = new
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
