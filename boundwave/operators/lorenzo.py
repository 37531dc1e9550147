"""Finite-difference predictors on the lattice of the error bound.

With step D = 2 tau every reconstruction is a multiple of D, so the closed loop of order k collapses to the
k-th difference of rint(x / D): lags of one window, no loop. Where x / D is an exact half, a sequential
coder may choose the other neighbour; both keep the bound. `closed_loop` has the sequential choice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the last reconstructions, by order.
WEIGHTS = {1: (1,), 2: (2, -1), 3: (3, -3, 1)}
NAMES = {1: "lorenzo1", 2: "lorenzo2", 3: "lorenzo3"}


def lattice(x: Column, tau: Column) -> Column:
    return F.rint(x / (2 * tau)).cast("long")


def indices(rows: DataFrame, orders=(1, 2, 3), keys=("sid", "rho")) -> DataFrame:
    """`rows` (…, t, x, tau) with q1..q3 and the reconstruction xhat; all lags share one sort."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = rows.withColumn("m", lattice(F.col("x"), F.col("tau")))
    for k in orders:
        p = sum(c * F.lag("m", i + 1, 0).over(w) for i, c in enumerate(WEIGHTS[k]))
        d = d.withColumn(f"q{k}", F.col("m") - p)
    return d.withColumn("xhat", F.col("m") * 2 * F.col("tau"))


def decode(rows: DataFrame, order: int, q: str, keys=("sid", "rho")) -> DataFrame:
    """xhat from the indices: `order` nested running sums, times the step."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("__m", F.col(q))
    for _ in range(order):
        d = d.withColumn("__m", F.sum("__m").over(w))
    return d.withColumn("decoded", F.col("__m") * 2 * F.col("tau")).drop("__m")


def long_form(rows: DataFrame, keys=("sid", "rho")) -> DataFrame:
    """(keys, predictor, t, q) of q1..q3."""
    pairs = F.array(*(F.struct(F.lit(NAMES[k]).alias("predictor"), F.col(f"q{k}").alias("q")) for k in WEIGHTS))
    return rows.select(*keys, "t", F.explode(pairs).alias("p")).select(*keys, "p.predictor", "t", "p.q")


def closed_loop(x: np.ndarray, tau: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(q, xhat), each sample predicted from the reconstructions before it."""
    step, weights = 2 * tau, WEIGHTS[order]
    q, xhat = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i, v in enumerate(x):
        p = sum(c * xhat[i - 1 - j] for j, c in enumerate(weights) if i - 1 - j >= 0)
        q[i] = int(np.rint((v - p) / step))
        xhat[i] = p + q[i] * step
    return q, xhat
