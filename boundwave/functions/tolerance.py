"""Error bounds: a share of a series' own standard deviation, with a floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RHOS = (0.01, 0.05, 0.2)
FLOOR = 0.5
SIGNIFICANT = 30  # binary digits that a bound keeps


def tau_of(sigma, rho, floor: float = FLOOR):
    """The bound, snapped to SIGNIFICANT binary digits, whatever its size: partial sums of a deviation may differ in their last bits."""
    tau = rho * sigma
    unit = F.pow(F.lit(2.0), F.floor(F.log2(tau)) - SIGNIFICANT)
    return F.greatest(F.when(tau > 0, F.rint(tau / unit) * unit).otherwise(0.0), F.lit(floor))


def tolerances(series: DataFrame, rhos=RHOS, floor: float = FLOOR) -> DataFrame:
    """(sid, rho, n, sigma, tau); one row for each series and rho."""
    stats = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sigma"))
    each = stats.select("sid", "n", "sigma", F.explode(F.array(*(F.lit(float(r)) for r in rhos))).alias("rho"))
    return each.select("sid", "rho", "n", "sigma", tau_of(F.col("sigma"), F.col("rho"), floor).alias("tau"))


def with_tau(series: DataFrame, rhos=RHOS, floor: float = FLOOR) -> DataFrame:
    """(sid, t, x, rho, tau). The bounds are a row for each series and rho; the join is on sid alone."""
    return series.join(tolerances(series, rhos, floor).select("sid", "rho", "tau"), "sid")


def within(error, tau, slack: float = 1e-6):
    return F.max(F.abs(error)) <= F.max(tau) + slack


def tau_sql(rhos=RHOS, floor: float = FLOOR) -> str:
    values = ", ".join(f"({r}::double)" for r in rhos)
    return f"""stats AS (SELECT sid, count(*) AS n, stddev_pop(x) AS sigma FROM series GROUP BY sid
), taus AS (SELECT sid, rho, n, sigma, greatest(CASE WHEN rho * sigma > 0 THEN round_even(rho * sigma / pow(2.0, floor(log2(rho * sigma)) - {SIGNIFICANT}), 0) * pow(2.0, floor(log2(rho * sigma)) - {SIGNIFICANT}) ELSE 0 END, {floor}::double) AS tau FROM stats CROSS JOIN (VALUES {values}) p(rho))"""
