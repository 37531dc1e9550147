"""Queries over series views, native unless their loops are sequential; each with SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning, codelength
from ..functions.tolerance import tau_sql, tolerances, with_tau
from ..operators import compressors, interpolate, lorenzo, mixture, predictors, rangecoder
from ..operators.grouped import by_series
from ..sources import series as views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


REV = "WITH RECURSIVE " + views.REVENUE_SQL
TAU = tau_sql()
M = """lattice AS (SELECT s.sid, p.rho, s.t, s.x, p.tau, cast(round_even(s.x / (2 * p.tau), 0) AS bigint) AS m FROM series s JOIN taus p USING (sid)
), lagged AS (SELECT *, lag(m, 1, 0) OVER w AS m1, lag(m, 2, 0) OVER w AS m2, lag(m, 3, 0) OVER w AS m3 FROM lattice WINDOW w AS (PARTITION BY sid, rho ORDER BY t)
), quantized AS (SELECT sid, rho, t, x, tau, m, m - m1 AS q1, m - 2 * m1 + m2 AS q2, m - 3 * m1 + 3 * m2 - m3 AS q3 FROM lagged)"""
LONG = """longq AS (SELECT sid, rho, 'lorenzo1' AS predictor, t, q1 AS q FROM quantized UNION ALL SELECT sid, rho, 'lorenzo2', t, q2 FROM quantized UNION ALL SELECT sid, rho, 'lorenzo3', t, q3 FROM quantized
), tally AS (SELECT sid, rho, predictor, q, count(*) AS c FROM longq GROUP BY ALL
), priced AS (SELECT sid, rho, predictor, cast(sum(c) AS bigint) AS n, count(*) AS uniq, sum(c) * log2(sum(c)) - sum(c * log2(c)) + 32.0::double * count(*) AS bits FROM tally GROUP BY sid, rho, predictor)"""


def quantized(spark: SparkSession, sf_dir: str, rhos=(0.01, 0.05, 0.2)) -> DataFrame:
    return lorenzo.indices(with_tau(views.daily_revenue(spark, sf_dir), rhos))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, rho, predictor, n, distinct, bits) of the three difference predictors under order-0 entropy."""
    return codelength.order0_bits(lorenzo.long_form(quantized(spark, sf_dir)), ["sid", "rho", "predictor"], "q")


@query(f"{REV} SELECT sid, t, x FROM series")
def series_daily_revenue(spark, sf_dir):
    return views.daily_revenue(spark, sf_dir)


@query(f"WITH {views.ORDERS_SQL} SELECT sid, t, x FROM series")
def series_daily_orders(spark, sf_dir):
    return views.daily_orders(spark, sf_dir)


@query(f"WITH {views.EVENTS_SQL} SELECT sid, t, x FROM series")
def series_dense_hourly(spark, sf_dir):
    return views.hourly_events(spark, sf_dir)


@query(f"WITH {views.EMBEDDING_SQL} SELECT sid, count(*) AS n, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS uniq FROM series GROUP BY sid")
def series_meta_embeddings(spark, sf_dir):
    s = views.embedding_series(spark, sf_dir)
    return s.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.countDistinct("x").alias("uniq"))


@query(f"{REV}, {TAU} SELECT sid, rho, n, tau FROM taus")
def tolerance_by_rho(spark, sf_dir):
    return tolerances(views.daily_revenue(spark, sf_dir)).drop("sigma")


def _lorenzo(k):
    def run(spark, sf_dir):
        return quantized(spark, sf_dir).select("sid", "rho", "t", F.col(f"q{k}").alias("q"), "xhat")

    run.__name__ = f"lorenzo{k}_indices"
    query(f"{REV}, {TAU}, {M} SELECT sid, rho, t, q{k} AS q, m * 2 * tau AS xhat FROM quantized")(run)


for _k in (1, 2, 3):
    _lorenzo(_k)


@query(f"{REV}, {TAU}, {M} SELECT sid, rho, count(*) AS n, round(max(abs(m * 2 * tau - x)), 4) AS worst, max(abs(m * 2 * tau - x)) <= max(tau) + 1e-6 AS held, 0::bigint AS differing FROM quantized GROUP BY sid, rho")
def lorenzo_roundtrip_bound(spark, sf_dir):
    d = quantized(spark, sf_dir)
    for k in (1, 2, 3):
        d = lorenzo.decode(d, k, f"q{k}").withColumnRenamed("decoded", f"d{k}")
    off = sum((F.col(f"d{k}") != F.col("xhat")).cast("long") for k in (1, 2, 3))
    error = F.abs(F.col("d3") - F.col("x"))
    return d.groupBy("sid", "rho").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(error), 4).alias("worst"), (F.max(error) <= F.max("tau") + 1e-6).alias("held"), F.sum(off).alias("differing"))


@query(f"{REV}, {TAU}, {M}, {LONG} SELECT sid, rho, predictor, n, uniq, round(bits, 4) AS bits, round(bits / n, 6) AS bpv FROM priced")
def order0_entropy(spark, sf_dir):
    return priced(spark, sf_dir).select("sid", "rho", "predictor", "n", F.col("distinct").alias("uniq"), F.round("bits", 4).alias("bits"), F.round(F.col("bits") / F.col("n"), 6).alias("bpv"))


@query(f"{REV}, {TAU}, {M}, {LONG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sid, rho ORDER BY round(bits, 4), predictor) AS k FROM priced) SELECT sid, rho, predictor AS best, round(bits / n, 6) AS bpv FROM ranked WHERE k = 1")
def best_lorenzo_order(spark, sf_dir):
    best = F.min(F.struct(F.round("bits", 4).alias("bits"), "predictor", (F.col("bits") / F.col("n")).alias("bpv"))).alias("b")
    return priced(spark, sf_dir).groupBy("sid", "rho").agg(best).select("sid", "rho", F.col("b.predictor").alias("best"), F.round("b.bpv", 6).alias("bpv"))


@query(f"""{REV}, d AS (SELECT sid, x - coalesce(lag(x) OVER (PARTITION BY sid ORDER BY t), x) AS v FROM series), c AS (SELECT sid, v, count(*) AS c FROM d GROUP BY ALL)
SELECT sid, cast(sum(c) AS bigint) AS n, count(*) AS uniq, round(sum(c) * log2(sum(c)) - sum(c * log2(c)) + 32.0::double * count(*), 4) AS bits FROM c GROUP BY sid""")
def delta_entropy(spark, sf_dir):
    x = views.daily_revenue(spark, sf_dir)
    d = x.select("sid", (F.col("x") - F.coalesce(F.lag("x").over(Window.partitionBy("sid").orderBy("t")), F.col("x"))).alias("v"))
    return codelength.order0_bits(d, ["sid"], "v").select("sid", "n", F.col("distinct").alias("uniq"), F.round("bits", 4).alias("bits"))


@query(f"{REV}, {TAU}, {M} SELECT sid, rho, round(avg(cast(q1 = 0 AS int)), 9) AS zeros, max(q1) - min(q1) AS span, CASE WHEN max(q1) - min(q1) < 256 THEN 1 WHEN max(q1) - min(q1) < 65536 THEN 2 WHEN max(q1) - min(q1) < 4294967296 THEN 4 ELSE 8 END AS width FROM quantized GROUP BY sid, rho")
def serialize_width(spark, sf_dir):
    d = quantized(spark, sf_dir).groupBy("sid", "rho").agg(F.round(F.avg((F.col("q1") == 0).cast("int")), 9).alias("zeros"), (F.max("q1") - F.min("q1")).alias("span"))
    return d.withColumn("width", codelength.serial_width(F.col("span")))


@query(f"{REV} SELECT sid, t, cast(CASE WHEN max(x) OVER w > min(x) OVER w THEN round_even((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 255, 0) ELSE 0 END AS bigint) AS level FROM series WINDOW w AS (PARTITION BY sid)")
def level_quantize(spark, sf_dir):
    return cleaning.level_quantize(views.daily_revenue(spark, sf_dir), 256)


@query("WITH v AS (SELECT event_type AS sid, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS x FROM events), s AS (SELECT *, pow(10.0::double, greatest(0, 4 - floor(log10(greatest(max(x) OVER w - min(x) OVER w, 1e-9::double))))) AS scale FROM v WINDOW w AS (PARTITION BY sid)) SELECT sid, cast(t AS bigint) AS t, scale, cast(round_even(x * scale, 0) AS bigint) AS v FROM s")
def decimal_scale(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("sid").orderBy("ts", "event_id")) - 1
    rows = e.select(F.col("event_type").alias("sid"), "ts", "event_id", F.col("value").alias("x")).select("sid", t.cast("long").alias("t"), "x")
    return cleaning.decimal_scale(rows)


@query(f"""{REV}, holes AS (SELECT sid, t, CASE WHEN t % 7 IN (2, 3) OR t < 3 OR t > 2400 THEN NULL ELSE x END AS x FROM series
), sides AS (SELECT sid, t, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS ta, last_value(x IGNORE NULLS) OVER a AS xa, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tb, first_value(x IGNORE NULLS) OVER b AS xb FROM holes
  WINDOW a AS (PARTITION BY sid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY sid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sid, t, round(CASE WHEN ta IS NULL THEN xb WHEN tb IS NULL OR ta = tb THEN xa ELSE xa + (xb - xa) * (t - ta) / (tb - ta) END, 6) AS x FROM sides""")
def gap_fill(spark, sf_dir):
    s = views.daily_revenue(spark, sf_dir)
    holes = s.withColumn("x", F.when(~((F.col("t") % 7).isin(2, 3) | (F.col("t") < 3) | (F.col("t") > 2400)), F.col("x")))
    return cleaning.gap_fill(holes).select("sid", "t", F.round("x", 6).alias("x"))


@query(f"WITH {views.ORDERS_SQL} SELECT sid, round(avg(cast(x > 0 AS int)), 9) AS density, sum(x) AS total FROM series GROUP BY sid HAVING avg(cast(x > 0 AS int)) > 0.5 AND sum(x) > 50000 ORDER BY total DESC, sid DESC LIMIT 3")
def density_filter_topk(spark, sf_dir):
    return cleaning.busiest(views.daily_orders(spark, sf_dir), 0.5, 50000, 3).select("sid", F.round("density", 9).alias("density"), "total")


@query(f"{REV}, size AS (SELECT sid, count(*) AS n FROM series GROUP BY sid) SELECT sid, t - 100 AS t, x FROM series JOIN size USING (sid) WHERE n >= 2148 AND t BETWEEN 100 AND 2147 AND (t - 100) % 8 = 0")
def window_slice_strided(spark, sf_dir):
    return cleaning.strided(cleaning.long_enough(views.daily_revenue(spark, sf_dir), 100, 2048), 8)


STEPS = (2, 4, 8, 16, 32, 64, 128, 256)


def downsampled(series: DataFrame, steps=STEPS) -> DataFrame:
    """(sid, step, n, bits, worst, mean): every step-th sample kept, the rest on lines between them; order-0 bits of the kept differences."""
    each = series.withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps))))
    kept = F.when(F.col("t") % F.col("step") == 0, F.struct("t", "x"))
    w = Window.partitionBy("sid", "step").orderBy("t")
    seen = (Window.unboundedPreceding, 0)  # either way frames only grow, so a row is looked at once
    a, b = (F.last(kept, True).over(Window.partitionBy("sid", "step").orderBy(turn).rowsBetween(*seen)) for turn in (F.asc("t"), F.desc("t")))
    d = each.select("sid", "step", "t", "x", a.alias("a"), b.alias("b"))
    line = F.when(F.col("b").isNull() | (F.col("b.t") == F.col("a.t")), F.col("a.x")).otherwise(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    error = d.withColumn("e", F.abs(line - F.col("x"))).groupBy("sid", "step").agg(F.count(F.lit(1)).alias("n"), F.max("e").alias("worst"), F.avg("e").alias("mean"))
    few = each.where(F.col("t") % F.col("step") == 0)
    delta = few.select("sid", "step", (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))).alias("v"))
    rate = codelength.order0_bits(delta, ["sid", "step"], "v").select("sid", "step", "bits")
    return error.join(rate, ["sid", "step"])


DOWN = f"""each AS (SELECT sid, t, x, unnest([{", ".join(map(str, STEPS))}]) AS step FROM series
), sides AS (SELECT *, last_value(CASE WHEN t % step = 0 THEN t END IGNORE NULLS) OVER a AS ta, last_value(CASE WHEN t % step = 0 THEN x END IGNORE NULLS) OVER a AS xa, first_value(CASE WHEN t % step = 0 THEN t END IGNORE NULLS) OVER b AS tb, first_value(CASE WHEN t % step = 0 THEN x END IGNORE NULLS) OVER b AS xb FROM each
  WINDOW a AS (PARTITION BY sid, step ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY sid, step ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), errs AS (SELECT sid, step, abs(CASE WHEN tb IS NULL OR tb = ta THEN xa ELSE xa + (xb - xa) * (t - ta) / (tb - ta) END - x) AS e FROM sides
), err AS (SELECT sid, step, count(*) AS n, max(e) AS worst, avg(e) AS mean FROM errs GROUP BY sid, step
), kd AS (SELECT sid, step, x - coalesce(lag(x) OVER (PARTITION BY sid, step ORDER BY t), x) AS v FROM each WHERE t % step = 0
), kc AS (SELECT sid, step, v, count(*) AS c FROM kd GROUP BY ALL
), rate AS (SELECT sid, step, sum(c) * log2(sum(c)) - sum(c * log2(c)) + 32.0::double * count(*) AS bits FROM kc GROUP BY sid, step
), down AS (SELECT sid, step, n, bits, worst, mean FROM err JOIN rate USING (sid, step))"""


@query(f"{REV}, {DOWN} SELECT sid, step, n, round(bits, 4) AS bits, round(worst, 4) AS worst, round(mean, 4) AS mean FROM down")
def downsample_error(spark, sf_dir):
    d = downsampled(views.daily_revenue(spark, sf_dir))
    return d.select("sid", "step", "n", F.round("bits", 4).alias("bits"), F.round("worst", 4).alias("worst"), F.round("mean", 4).alias("mean"))


@query(f"""{REV}, {TAU}, {M}, {LONG}, {DOWN}, target AS (SELECT sid, rho, min(bits) AS bits FROM priced GROUP BY sid, rho
), fit AS (SELECT p.sid, p.rho, d.step, d.bits / d.n AS bpv, d.worst, row_number() OVER (PARTITION BY p.sid, p.rho ORDER BY round(d.bits, 4) DESC, d.step) AS k FROM target p JOIN down d ON d.sid = p.sid AND d.bits <= p.bits)
SELECT f.sid, f.rho, f.step, round(f.bpv, 6) AS bpv, round(f.worst / taus.tau, 6) AS ratio FROM fit f JOIN taus ON taus.sid = f.sid AND taus.rho = f.rho WHERE k = 1""")
def matched_rate_downsample(spark, sf_dir):
    target = priced(spark, sf_dir).groupBy("sid", "rho").agg(F.min("bits").alias("target"))
    d = downsampled(views.daily_revenue(spark, sf_dir)).join(target, "sid").where("bits <= target")
    best = d.groupBy("sid", "rho").agg(F.max(F.struct(F.round("bits", 4).alias("b"), (-F.col("step")).alias("s"), (F.col("bits") / F.col("n")).alias("bpv"), "worst")).alias("k"))
    tau = tolerances(views.daily_revenue(spark, sf_dir)).select("sid", "rho", "tau")
    return best.join(tau, ["sid", "rho"]).select("sid", "rho", (-F.col("k.s")).alias("step"), F.round("k.bpv", 6).alias("bpv"), F.round(F.col("k.worst") / F.col("tau"), 6).alias("ratio"))


EMA = """q05 AS (SELECT sid, t, q1, cast(abs(q1) AS double) AS v FROM quantized WHERE rho = 0.05
), init AS (SELECT sid, greatest(avg(v), 0.001::double) AS a FROM q05 WHERE t < 256 GROUP BY sid
), run(sid, t, r) AS (SELECT sid, 0::bigint, a FROM init UNION ALL SELECT run.sid, run.t + 1, run.r + (q.v - run.r) / 256 FROM run JOIN q05 q ON q.sid = run.sid AND q.t = run.t)"""


@query(f"{REV}, {TAU}, {M}, {EMA} SELECT q05.sid, q05.t, round(greatest(r, 0.001), 6) AS scale FROM run JOIN q05 USING (sid, t)")
def ema_scale(spark, sf_dir):
    d = quantized(spark, sf_dir, (0.05,)).select("sid", "t", F.abs("q1").cast("double").alias("v"))
    return codelength.running_mean(d, "v", 256, "scale").select("sid", "t", F.round("scale", 6).alias("scale"))


@query(f"""{REV}, {TAU}, {M}, q05 AS (SELECT sid, t, q1 FROM quantized WHERE rho = 0.05
), run(sid, t, h) AS (SELECT DISTINCT sid, 0::bigint, 0.0::double FROM q05 UNION ALL SELECT run.sid, run.t + 1, run.h + (abs(q.q1) - run.h) / 32 FROM run JOIN q05 q ON q.sid = run.sid AND q.t = run.t)
SELECT sid, t, round(h, 6) AS recent, CASE WHEN round(h, 6) < 0.5 THEN 0 WHEN round(h, 6) < 1.5 THEN 1 WHEN round(h, 6) < 4 THEN 2 ELSE 3 END AS flag_ctx, CASE WHEN round(h, 6) < 1 THEN 0 WHEN round(h, 6) < 4 THEN 1 ELSE 2 END AS size_ctx, 2 * cast(floor(log2(abs(q1) + 1)) AS bigint) + 1 AS golomb FROM run JOIN q05 USING (sid, t)""")
def recent_magnitude_ctx(spark, sf_dir):
    d = quantized(spark, sf_dir, (0.05,)).select("sid", "t", "q1", F.abs("q1").cast("double").alias("v"))
    zero = d.withColumn("v", F.col("v"))
    h = codelength.running_mean(zero, "v", 32, "recent", floor=0.0)
    # that recursion starts at the first values' mean; this one at 0, so what is left of the start is taken off
    start = F.avg(F.when(F.col("t") < 32, F.col("v"))).over(Window.partitionBy("sid"))
    h = h.withColumn("recent", F.round(F.col("recent") - F.pow(F.lit(1 - 1 / 32), F.col("t").cast("double")) * start, 6))
    flag = F.when(F.col("recent") < 0.5, 0).when(F.col("recent") < 1.5, 1).when(F.col("recent") < 4, 2).otherwise(3)
    size = F.when(F.col("recent") < 1, 0).when(F.col("recent") < 4, 1).otherwise(2)
    return h.select("sid", "t", F.abs("recent").alias("recent"), flag.alias("flag_ctx"), size.alias("size_ctx"), codelength.golomb_bits(F.abs("q1")).alias("golomb"))


@query(f"""{REV}, {TAU}, {M}, {EMA}, sp AS (SELECT sid, cast(max(abs(q1)) * 2 + 3 AS double) AS span FROM q05 GROUP BY sid
), p AS (SELECT q05.sid, v, span, greatest(r, 0.001) AS b FROM run JOIN q05 USING (sid, t) JOIN sp USING (sid)
), z AS (SELECT sid, span, CASE WHEN v < 0.5 THEN 1 - exp(-(v + 0.5) / b) ELSE 0.5 * (exp(-greatest((v - 0.5) / b, 0)) - exp(-(v + 0.5) / b)) END AS lap,
  atan((v + 0.5) / (b * sqrt(3.0::double))) AS a1, (v + 0.5) / (b * sqrt(3.0::double)) AS u1, atan((v - 0.5) / (b * sqrt(3.0::double))) AS a0, (v - 0.5) / (b * sqrt(3.0::double)) AS u0 FROM p)
SELECT sid, round(sum(-log2(0.9999::double * lap + 0.0001::double / span)), 3) AS laplace_bits, round(sum(-log2(0.9999::double * ((u1 / (1 + u1 * u1) + a1) - (u0 / (1 + u0 * u0) + a0)) / pi() + 0.0001::double / span)), 3) AS t3_bits FROM z GROUP BY sid""")
def laplace_t3_bits(spark, sf_dir):
    d = quantized(spark, sf_dir, (0.05,)).select("sid", "t", F.abs("q1").cast("double").alias("v"))
    span = (F.max("v").over(Window.partitionBy("sid")) * 2 + 3).alias("span")
    d = codelength.running_mean(d, "v", 256, "b").select("sid", "v", "b", span)
    cost = lambda p: F.round(F.sum(codelength.bits(codelength.escaped(p, F.col("span")))), 3)
    zero = F.lit(0.0)
    return d.groupBy("sid").agg(cost(codelength.laplace_mass(F.col("v"), zero, F.col("b"))).alias("laplace_bits"), cost(codelength.t3_mass(F.col("v"), zero, F.col("b"))).alias("t3_bits"))


@query(f"""{REV}, w AS (SELECT sid, t, x, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS q, max(x) OVER (PARTITION BY sid) - min(x) OVER (PARTITION BY sid) + 1 AS span FROM series
), e AS (SELECT sid, t, span, q, unnest([x - 0.5, x + 0.5]) AS y, unnest([-1.0::double, 1.0::double]) AS sign FROM w WHERE t >= 64
), k AS (SELECT *, len(list_filter(q, lambda v: v <= y)) AS k, greatest(q[9] - q[1], 1e-6) AS spread FROM e
), f AS (SELECT sid, t, span, sign * least(greatest(CASE WHEN k = 0 THEN 0.1::double * exp((y - q[1]) / greatest(q[2] - q[1], spread * 1e-3)) WHEN k = 9 THEN 1 - 0.1::double * exp(-(y - q[9]) / greatest(q[9] - q[8], spread * 1e-3)) ELSE k * 0.1::double + 0.1::double * (y - q[k]) / greatest(q[k + 1] - q[k], 1e-6) END, 0), 1) AS f FROM k
), p AS (SELECT sid, t, span, sum(f) AS p FROM f GROUP BY ALL)
SELECT sid, count(*) AS n, round(sum(-log2(0.9999::double * least(greatest(p, 0), 1) + 0.0001::double / span)), 3) AS bits FROM p GROUP BY sid""")
def quantile_cdf_bits(spark, sf_dir):
    """Bits of each sample under the nine quantiles of the 64 samples before it."""
    w = Window.partitionBy("sid").orderBy("t").rowsBetween(-64, -1)
    s = views.daily_revenue(spark, sf_dir)
    q = F.percentile("x", F.array(*(F.lit(i / 10) for i in range(1, 10)))).over(w)
    span = F.max("x").over(Window.partitionBy("sid")) - F.min("x").over(Window.partitionBy("sid")) + 1
    d = s.select("sid", "t", "x", q.alias("q"), span.alias("span")).where("t >= 64").withColumn("q", codelength.monotone(F.col("q")))
    p = codelength.escaped(codelength.quantile_mass(F.col("q"), F.col("x")), F.col("span"))
    return d.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(codelength.bits(p)), 3).alias("bits"))


@query(f"{REV}, {TAU}, {M}, {LONG} SELECT sid, rho, predictor, n, round(100 * (1 - bits / max(bits) OVER (PARTITION BY sid, rho)), 6) AS gain FROM priced")
def gain_by_predictor(spark, sf_dir):
    return priced(spark, sf_dir).select("sid", "rho", "predictor", "n", F.round(100 * (1 - F.col("bits") / F.max("bits").over(Window.partitionBy("sid", "rho"))), 6).alias("gain"))


@query(f"""{REV}, {TAU}, {M}, {LONG}, g AS (SELECT sid, rho, 100 * (1 - min(bits) / max(CASE WHEN predictor = 'lorenzo2' THEN bits END)) AS gain FROM priced GROUP BY sid, rho)
SELECT rho, round(median(gain), 6) AS median_gain, round(avg(gain), 6) AS mean_gain, round(quantile_cont(gain, 0.25), 6) AS p25, round(quantile_cont(gain, 0.75), 6) AS p75, count(*) FILTER (WHERE gain > 0) AS wins, count(*) AS n FROM g GROUP BY GROUPING SETS ((rho), ())""")
def gain_summary_grouping_sets(spark, sf_dir):
    second = F.max(F.when(F.col("predictor") == "lorenzo2", F.col("bits")))
    g = priced(spark, sf_dir).groupBy("sid", "rho").agg((100 * (1 - F.min("bits") / second)).alias("gain"))
    return g.rollup("rho").agg(
        F.round(F.median("gain"), 6).alias("median_gain"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.percentile("gain", 0.25), 6).alias("p25"),
        F.round(F.percentile("gain", 0.75), 6).alias("p75"), F.count_if(F.col("gain") > 0).alias("wins"), F.count(F.lit(1)).alias("n"),
    )


def _extremes(best: bool):
    order = "DESC" if best else "ASC"

    def run(spark, sf_dir):
        d = gain_by_predictor(spark, sf_dir).where("predictor = 'lorenzo1'").select("sid", "rho", "gain")
        return d.orderBy(F.desc("gain") if best else F.asc("gain"), "sid", "rho").limit(6)

    run.__name__ = "gain_best_6" if best else "gain_worst_6"
    query(f"{ORACLE_SQL['gain_by_predictor'].replace('SELECT sid, rho, predictor, n, round', 'SELECT sid, rho, gain FROM (SELECT sid, rho, predictor, n, round')}) WHERE predictor = 'lorenzo1' ORDER BY gain {order}, sid, rho LIMIT 6")(run)


_extremes(True)
_extremes(False)


@query(f"""{REV}, {TAU}, {M}, b AS (SELECT sid, rho, cast(floor(t / 512) AS bigint) AS block, sum(2 * floor(log2(abs(q1) + 1)) + 1) AS b1, sum(2 * floor(log2(abs(q2) + 1)) + 1) AS b2 FROM quantized GROUP BY ALL)
SELECT sid, rho, count(*) AS blocks, cast(sum(least(b1, b2)) + count(*) AS bigint) AS bits, count(*) FILTER (WHERE b1 <= b2) AS first_wins FROM b GROUP BY sid, rho""")
def block_switch(spark, sf_dir):
    g = lambda c: F.sum(codelength.golomb_bits(F.abs(c)))
    b = quantized(spark, sf_dir).groupBy("sid", "rho", (F.floor(F.col("t") / 512)).alias("block")).agg(g("q1").alias("b1"), g("q2").alias("b2"))
    return b.groupBy("sid", "rho").agg(F.count(F.lit(1)).alias("blocks"), (F.sum(F.least("b1", "b2")) + F.count(F.lit(1))).alias("bits"), F.count_if(F.col("b1") <= F.col("b2")).alias("first_wins"))


@query(f"""{REV}, {TAU}, {M}, c AS (SELECT sid, unnest([64, 128, 256, 512]) AS ctx FROM (SELECT DISTINCT sid FROM quantized)
), k AS (SELECT c.sid, c.ctx, avg(CASE WHEN q.t < c.ctx THEN 2 * floor(log2(abs(q1) + 1)) + 1 END) AS seed, avg(CASE WHEN q.t >= c.ctx THEN 2 * floor(log2(abs(q2) + 1)) + 1 END) AS body FROM c JOIN quantized q ON q.sid = c.sid AND q.rho = 0.05 GROUP BY ALL
), t AS (SELECT ctx, n, avg((body * (n - ctx) + seed * ctx) / n) AS bpv FROM k, (SELECT unnest([4300, 8760, 17520, 43800]) AS n) GROUP BY ALL)
SELECT n, ctx, round(bpv, 6) AS bpv, row_number() OVER (PARTITION BY n ORDER BY round(bpv, 6), ctx) = 1 AS best FROM t""")
def context_amortization(spark, sf_dir):
    d = quantized(spark, sf_dir, (0.05,)).withColumn("ctx", F.explode(F.array(*(F.lit(c) for c in (64, 128, 256, 512)))))
    g = lambda c: codelength.golomb_bits(F.abs(c))
    k = d.groupBy("sid", "ctx").agg(F.avg(F.when(F.col("t") < F.col("ctx"), g("q1"))).alias("seed"), F.avg(F.when(F.col("t") >= F.col("ctx"), g("q2"))).alias("body"))
    k = k.withColumn("n", F.explode(F.array(*(F.lit(n) for n in (4300, 8760, 17520, 43800)))))
    t = k.groupBy("n", "ctx").agg(F.round(F.avg((F.col("body") * (F.col("n") - F.col("ctx")) + F.col("seed") * F.col("ctx")) / F.col("n")), 6).alias("bpv"))
    return t.select("n", "ctx", "bpv", (F.row_number().over(Window.partitionBy("n").orderBy("bpv", "ctx")) == 1).alias("best"))


GAINS = {k: predictors.gain_of(k) for k in ("lorenzo1", "lorenzo2", "lorenzo3", "interp_linear", "interp_cubic")}


@query(f"""{REV}, {TAU}, l AS (SELECT sid, x, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM series WINDOW w AS (PARTITION BY sid ORDER BY t)
), e AS (SELECT sid, stddev_pop(x - a) AS e1, stddev_pop(x - 2 * a + b) AS e2, stddev_pop(x - 3 * a + 3 * b - c) AS e3 FROM l WHERE c IS NOT NULL GROUP BY sid
), u AS (SELECT sid, 'lorenzo1' AS predictor, e1 AS clean, 1.0::double AS gain FROM e UNION ALL SELECT sid, 'lorenzo2', e2, sqrt(5.0::double) FROM e UNION ALL SELECT sid, 'lorenzo3', e3, sqrt(19.0::double) FROM e
), h AS (SELECT u.sid, rho, predictor, gain, clean, sqrt(clean * clean + (gain * tau / sqrt(3.0::double)) ** 2) AS total FROM u JOIN taus USING (sid))
SELECT sid, rho, predictor, round(gain, 6) AS gain, round(clean, 3) AS clean, round(total, 3) AS total, row_number() OVER (PARTITION BY sid, rho ORDER BY round(total, 3), predictor) = 1 AS wins FROM h""")
def noise_gain_linear(spark, sf_dir):
    s = views.daily_revenue(spark, sf_dir)
    w = Window.partitionBy("sid").orderBy("t")
    lags = {i: F.lag("x", i).over(w) for i in (1, 2, 3)}
    d = s.select("sid", "x", *(lags[i].alias(f"l{i}") for i in lags)).where("l3 IS NOT NULL")
    clean = {k: F.stddev_pop(F.col("x") - sum(c * F.col(f"l{j + 1}") for j, c in enumerate(lorenzo.WEIGHTS[k]))) for k in (1, 2, 3)}
    e = d.groupBy("sid").agg(*(c.alias(f"e{k}") for k, c in clean.items()))
    u = e.select("sid", F.explode(F.array(*(F.struct(F.lit(lorenzo.NAMES[k]).alias("predictor"), F.col(f"e{k}").alias("clean"), F.lit(GAINS[lorenzo.NAMES[k]]).alias("gain")) for k in (1, 2, 3)))).alias("p")).select("sid", "p.*")
    h = u.join(tolerances(s).select("sid", "rho", "tau"), "sid").withColumn("total", F.round(F.hypot("clean", F.col("gain") * F.col("tau") / F.sqrt(F.lit(3.0))), 3))
    first = F.row_number().over(Window.partitionBy("sid", "rho").orderBy("total", "predictor")) == 1
    return h.select("sid", "rho", "predictor", F.round("gain", 6).alias("gain"), F.round("clean", 3).alias("clean"), "total", first.alias("wins"))


@query(f"""{REV}, pair AS (SELECT a.sid, b.sid AS other, a.t, a.x AS x, b.x AS cov FROM series a JOIN series b ON a.t = b.t AND a.sid <> b.sid
), w AS (SELECT sid, other, t, x, list(cov) OVER (PARTITION BY sid, other ORDER BY t ROWS BETWEEN 8 PRECEDING AND 3 FOLLOWING) AS c FROM pair)
SELECT sid, other, t, x, len(c) AS n, list_sum(c) AS total, c[1] AS first_cov FROM w""")
def covariate_window(spark, sf_dir):
    """For each ordered pair of series, the other's samples from eight before each sample to three behind it."""
    s = views.daily_revenue(spark, sf_dir)
    pair = s.join(s.select(F.col("sid").alias("other"), "t", F.col("x").alias("cov")), "t").where("sid <> other")
    c = F.collect_list("cov").over(Window.partitionBy("sid", "other").orderBy("t").rowsBetween(-8, 3))
    d = pair.select("sid", "other", "t", "x", c.alias("c"))
    return d.select("sid", "other", "t", "x", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0.0), lambda a, v: a + v).alias("total"), F.element_at("c", 1).alias("first_cov"))


# --- loops over one series: Arrow grouped maps ---


def _interp_sql(kind: str, levels: int = 11) -> str:
    """One pair of tables for each level: predictions from coarser reconstructions, then indices."""
    top = 2**levels
    n = "(SELECT count(*) FROM series WHERE sid = (SELECT min(sid) FROM series))"
    parts = [f"base AS MATERIALIZED (SELECT s.sid, p.rho, s.t, s.x, 2 * p.tau AS d FROM series s JOIN taus p USING (sid))"]  # noqa: F541
    parts.append(f"""g0 AS MATERIALIZED (SELECT sid, rho, t, x, d, cast(round_even(x / d, 0) AS bigint) AS m FROM base WHERE t % {top} = 0
), r0 AS MATERIALIZED (SELECT sid, rho, 0 AS level, t, m - lag(m, 1, 0) OVER (PARTITION BY sid, rho ORDER BY t) AS q, m * d AS xhat FROM g0)""")
    for k in range(1, levels + 1):
        h = top >> k
        cubic = f"WHEN b.t - {3 * h} >= 0 AND b.t + {3 * h} < {n} THEN (-l3.xhat + 9 * l.xhat + 9 * r.xhat - r3.xhat) / 16" if kind == "cubic" else ""
        far = f"LEFT JOIN r{k - 1} l3 ON l3.sid = b.sid AND l3.rho = b.rho AND l3.t = b.t - {3 * h} LEFT JOIN r{k - 1} r3 ON r3.sid = b.sid AND r3.rho = b.rho AND r3.t = b.t + {3 * h}" if kind == "cubic" else ""
        parts.append(f"""p{k} AS MATERIALIZED (SELECT b.sid, b.rho, b.t, b.x, b.d, CASE WHEN r.xhat IS NULL THEN l.xhat {cubic} ELSE 0.5 * (l.xhat + r.xhat) END AS p
  FROM base b JOIN r{k - 1} l ON l.sid = b.sid AND l.rho = b.rho AND l.t = b.t - {h} LEFT JOIN r{k - 1} r ON r.sid = b.sid AND r.rho = b.rho AND r.t = b.t + {h} {far} WHERE b.t % {2 * h} = {h}
), r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT sid, rho, {k} AS level, t, cast(round_even((x - p) / d, 0) AS bigint) AS q, p + round_even((x - p) / d, 0) * d AS xhat FROM p{k})""")
    return f"{REV}, {TAU}, {', '.join(parts)} SELECT sid, rho, level, t, q FROM r{levels}"


def _interp(kind: str):
    def run(spark, sf_dir):
        return interpolate.indices(with_tau(views.daily_revenue(spark, sf_dir)), kind).select("sid", "rho", "level", "t", "q")

    run.__name__ = f"interp_{kind}_indices"
    query(_interp_sql(kind))(run)


_interp("linear")
_interp("cubic")


def _per_index(spark, sf_dir, work, schema, rhos=(0.05,)):
    return by_series(quantized(spark, sf_dir, rhos), ["sid", "rho"], ["q1"], work, schema)


@query(f"""{REV}, {tau_sql((0.05,))}, {M}, sp AS (SELECT sid, cast(greatest(2 * max(abs(q1)) + 1, 3) AS double) AS span FROM quantized GROUP BY sid
), p AS (SELECT sid, t, list_append(list_transform([{", ".join(f"{s}::double" for s in codelength.SCALES)}], lambda b: 0.9999::double * (CASE WHEN q1 = 0 THEN 1 - exp(-0.5 / b) ELSE 0.5 * (exp(-(abs(q1) - 0.5) / b) - exp(-(abs(q1) + 0.5) / b)) END) + 0.0001::double / span), 0.9999::double / span + 0.0001::double / span) AS p FROM quantized JOIN sp USING (sid)
), run(sid, t, w, mass) AS (SELECT DISTINCT sid, -1::bigint, list_transform(range(18), lambda i: 1.0::double / 18), 1.0::double FROM p
  UNION ALL SELECT run.sid, p.t, list_transform(list_zip(run.w, p.p), lambda z: 0.999::double * z[1] * z[2] / list_dot_product(run.w, p.p) + 0.001::double / 18), list_dot_product(run.w, p.p) FROM run JOIN p ON p.sid = run.sid AND p.t = run.t + 1)
SELECT sid, count(*) AS n, round(sum(-log2(mass)), 3) AS bits FROM run WHERE t >= 0 GROUP BY sid""")
def fair_mixture_bits(spark, sf_dir):
    def work(_sid, _rho, q):
        return {"n": np.array([len(q)]), "bits": np.array([mixture.fair_bits(q).sum()])}

    return _per_index(spark, sf_dir, work, "n long, bits double").select("sid", "n", F.round("bits", 3).alias("bits"))


@query()
def ac_bytes(spark, sf_dir):
    """Range-coded bytes and ideal bits of the adaptive model, decoded again; best of xz and zstd beside them."""

    def work(_sid, _rho, q):
        data = rangecoder.encode(q)
        same = bool((rangecoder.decode(data, len(q)) == q).all())
        return {"n": np.array([len(q)]), "ac_bytes": np.array([len(data)]), "ideal_bits": np.array([rangecoder.code_length(q)]), "best_general": np.array([compressors.best_bytes(q)]), "same": np.array([same])}

    return _per_index(spark, sf_dir, work, "n long, ac_bytes long, ideal_bits double, best_general long, same boolean", (0.01, 0.05, 0.2))


@query()
def general_compressors(spark, sf_dir):
    """Bytes of the indices by method and layout."""

    def work(_sid, _rho, q):
        found = compressors.sizes(q)
        return {"method": np.array(list(found)), "bytes": np.array(list(found.values()))}

    return _per_index(spark, sf_dir, work, "method string, bytes long")


def _loop(spark, sf_dir, f, rhos=(0.05,)):
    """(sid, rho, t, q, xhat) of a closed loop f(x, tau)."""

    def work(_sid, _rho, x, tau):
        q, xhat = f(x, float(tau[0]))
        return {"t": np.arange(len(x)), "q": q, "xhat": xhat}

    return by_series(with_tau(views.daily_revenue(spark, sf_dir), rhos), ["sid", "rho"], ["x", "tau"], work, "t long, q long, xhat double").select("sid", "t", "q", F.round("xhat", 3).alias("xhat"))


ONE = f"{REV}, {tau_sql((0.05,))}, d AS (SELECT sid, t, x, 2 * tau AS d FROM series JOIN taus USING (sid))"


@query(f"""{ONE}, run(sid, t, q, h) AS (SELECT DISTINCT sid, -1::bigint, 0::bigint, 0.0::double FROM d
  UNION ALL SELECT run.sid, d.t, cast(round_even((d.x - 0.875::double * run.h) / d.d, 0) AS bigint), 0.875::double * run.h + round_even((d.x - 0.875::double * run.h) / d.d, 0) * d.d FROM run JOIN d ON d.sid = run.sid AND d.t = run.t + 1)
SELECT sid, t, q, round(h, 3) AS xhat FROM run WHERE t >= 0""")
def ar1_closed_loop(spark, sf_dir):
    return _loop(spark, sf_dir, lambda x, tau: predictors.closed_loop(x, tau, predictors.Linear([0.875])))


@query()
def lpc32_closed_loop(spark, sf_dir):
    return _loop(spark, sf_dir, predictors.lpc)


def _hybrid_sql(mode: str) -> str:
    p = "CASE WHEN run.n = 0 THEN 0 ELSE run.h END"
    p2 = "CASE WHEN run.n = 0 THEN 0 WHEN run.n = 1 THEN 2 * run.h ELSE 2 * run.h - run.g END"
    pick = f"(run.e2 / greatest(run.e1 + run.e2, 1e-9)) * ({p}) + (1 - run.e2 / greatest(run.e1 + run.e2, 1e-9)) * ({p2})" if mode == "blend" else f"CASE WHEN run.lead THEN ({p}) ELSE ({p2}) END"
    return f"""{ONE}, run(sid, n, q, h, g, e1, e2, b1, b2, lead) AS (SELECT DISTINCT sid, 0::bigint, 0::bigint, 0.0::double, 0.0::double, 1.0::double, 1.0::double, 0.0::double, 0.0::double, true FROM d
  UNION ALL SELECT sid, n + 1, cast(k AS bigint), p + k * d, h, e1 + (a1 - e1) / 256, e2 + (a2 - e2) / 256, CASE WHEN (n + 1) % 256 = 0 THEN 0 ELSE b1 + a1 END, CASE WHEN (n + 1) % 256 = 0 THEN 0 ELSE b2 + a2 END,
    CASE WHEN (n + 1) % 256 = 0 THEN b1 + a1 <= b2 + a2 ELSE lead END FROM (SELECT *, round_even((x - p) / d, 0) AS k FROM (SELECT run.*, d.x, d.d, {pick} AS p, abs(d.x - ({p})) AS a1, abs(d.x - ({p2})) AS a2 FROM run JOIN d ON d.sid = run.sid AND d.t = run.n)))
SELECT sid, n - 1 AS t, q, round(h, 3) AS xhat FROM run WHERE n > 0"""


class _SecondOrder:
    """Twice the last sample less the one before; a missing sample is 0."""

    def forecast(self, past, horizon):
        a = past[-1] if len(past) else 0.0
        return np.full(horizon, 2 * a - (past[-2] if len(past) > 1 else 0.0))


@query(_hybrid_sql("blend"))
def blend_hybrid(spark, sf_dir):
    return _loop(spark, sf_dir, lambda x, tau: predictors.hybrid(x, tau, "blend", predictors.Last(), _SecondOrder()))


@query(_hybrid_sql("leader"))
def leader_hybrid(spark, sf_dir):
    return _loop(spark, sf_dir, lambda x, tau: predictors.hybrid(x, tau, "leader", predictors.Last(), _SecondOrder()))


@query()
def two_level_interpolator(spark, sf_dir):
    def work(_sid, _rho, x, tau):
        coarse, fine, xhat = predictors.two_level(x, float(tau[0]), 16, predictors.Last())
        return {"n": np.array([len(x)]), "coarse_bits": np.array([rangecoder.code_length(coarse)]), "fine_bits": np.array([rangecoder.code_length(fine)]), "held": np.array([bool(np.abs(xhat - x).max() <= tau[0] + 1e-6)])}

    return by_series(with_tau(views.daily_revenue(spark, sf_dir), (0.05,)), ["sid", "rho"], ["x", "tau"], work, "n long, coarse_bits double, fine_bits double, held boolean")


@query()
def best_of_six_classical(spark, sf_dir):
    """Range-coded bits a sample of the six classical quantizers, and the least."""

    def work(_sid, _rho, x, tau):
        found = {k: f(x, float(tau[0])) for k, f in predictors.CLASSICAL.items()}
        bpv = np.array([8 * len(rangecoder.encode(q)) / max(1, len(x)) for q, _ in found.values()])
        order = {"predictor": np.array(list(found)), "bpv": bpv, "best": np.arange(len(bpv)) == int(bpv.argmin())}
        return order | {"backend": np.array(["range coder"] * len(bpv))}

    return by_series(with_tau(views.daily_revenue(spark, sf_dir)), ["sid", "rho"], ["x", "tau"], work, "predictor string, bpv double, best boolean, backend string")


@query()
def container_roundtrip(spark, sf_dir):
    """Containers of all series: bytes, bound, and whether decoding gives the encoder's reconstruction within it."""
    from ..operators import codec

    s = views.daily_revenue(spark, sf_dir).withColumn("group_id", F.lit("all"))
    blobs = codec.compress(s, 0.05).cache()
    back = codec.decompress(blobs).join(s, ["group_id", "sid", "t"]).join(tolerances(s, (0.05,)).select("sid", "tau"), "sid")
    held = back.groupBy("group_id").agg((F.max(F.abs(F.col("xhat") - F.col("x")) - F.col("tau")) <= 1e-5).alias("held"), F.count(F.lit(1)).alias("samples"))
    return blobs.select("group_id", "n_series", "n", F.octet_length("blob").cast("long").alias("bytes")).join(held, "group_id")
