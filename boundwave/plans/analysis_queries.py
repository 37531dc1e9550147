"""Comparison queries: experts and mixtures, selections, regressions, verification of claims."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codelength
from ..functions.tolerance import tolerances, with_tau
from ..operators import compressors, mixture, predictors, rangecoder
from ..operators.grouped import by_series
from ..sources import series as views
from .series_queries import EMA, LONG, M, REV, TAU, priced, quantized

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register



def by_t():
    return Window.partitionBy("sid").orderBy("t")


@query(f"""{REV}, l AS (SELECT sid, x, lag(x, 1) OVER w AS a, lag(x, 7) OVER w AS b FROM series WINDOW w AS (PARTITION BY sid ORDER BY t))
SELECT sid, round(avg(abs(x - a)), 4) AS mae_last, round(avg(abs(x - b)), 4) AS mae_week, round(log2(avg(abs(x - a)) / avg(abs(x - b))), 6) AS bits_saved FROM l WHERE b IS NOT NULL GROUP BY sid""")
def accuracy_law(spark, sf_dir):
    """Bits that a better predictor saves: log2 of the ratio of mean absolute errors."""
    s = views.daily_revenue(spark, sf_dir).select("sid", "x", F.lag("x", 1).over(by_t()).alias("a"), F.lag("x", 7).over(by_t()).alias("b")).where("b IS NOT NULL")
    e = s.groupBy("sid").agg(F.avg(F.abs(F.col("x") - F.col("a"))).alias("m1"), F.avg(F.abs(F.col("x") - F.col("b"))).alias("m7"))
    return e.select("sid", F.round("m1", 4).alias("mae_last"), F.round("m7", 4).alias("mae_week"), F.round(F.log2(F.col("m1") / F.col("m7")), 6).alias("bits_saved"))


@query(f"""{REV}, {TAU}, d AS (SELECT s.sid, p.rho, abs(cast(cast(s.x / 7 AS float) AS double) - s.x / 7) / (2 * p.tau) AS drift FROM series s JOIN taus p USING (sid))
SELECT sid, rho, round(max(drift), 12) AS per_sample, round(1 / max(drift), 0) AS expected_samples FROM d GROUP BY sid, rho""")
def desync_estimate(spark, sf_dir):
    """How soon a decoder that computes in single precision would leave the encoder's lattice."""
    d = with_tau(views.daily_revenue(spark, sf_dir)).select("sid", "rho", (F.abs((F.col("x") / 7).cast("float").cast("double") - F.col("x") / 7) / (2 * F.col("tau"))).alias("drift"))
    return d.groupBy("sid", "rho").agg(F.round(F.max("drift"), 12).alias("per_sample"), F.round(1 / F.max("drift"), 0).alias("expected_samples"))


@query(f"WITH {views.ORDERS_SQL}, ids AS (SELECT DISTINCT sid FROM series) SELECT sid, row_number() OVER (ORDER BY CASE WHEN sid IN ('3-MEDIUM', '1-URGENT') THEN 0 ELSE 1 END, sid) AS place FROM ids QUALIFY place <= 3")
def priority_selection(spark, sf_dir):
    """The first three series, preferred ones before the rest."""
    order = [F.when(F.col("sid").isin("3-MEDIUM", "1-URGENT"), 0).otherwise(1), F.col("sid")]
    ids = views.daily_orders(spark, sf_dir).select("sid").distinct().orderBy(*order).limit(3)  # a handful of rows
    return ids.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(f"""{REV}, {TAU}, {M}, {LONG} SELECT p.sid, p.rho, p.predictor, round(p.bits / p.n, 6) AS bpv FROM priced p
WHERE EXISTS (SELECT 1 FROM taus t WHERE t.sid = p.sid AND t.rho = p.rho AND t.rho < 0.1) AND p.sid NOT IN ('N')""")
def cached_selection(spark, sf_dir):
    """Results whose bound is among the wanted ones, without an excluded series."""
    wanted = tolerances(views.daily_revenue(spark, sf_dir)).where("rho < 0.1").select("sid", "rho")
    bad = spark.createDataFrame([("N",)], "sid string")
    rows = priced(spark, sf_dir).join(wanted, ["sid", "rho"], "left_semi").join(bad, "sid", "left_anti")
    return rows.select("sid", "rho", "predictor", F.round(F.col("bits") / F.col("n"), 6).alias("bpv"))


@query(f"""{REV}, {TAU}, {M}, {LONG}, a AS (SELECT sid, rho, bits AS old FROM priced WHERE predictor = 'lorenzo1'), b AS (SELECT sid, rho, bits AS new FROM priced WHERE predictor = 'lorenzo2')
SELECT split_part(sid || '|' || rho, '|', 1) AS name, rho, round(100 * (1 - new / old), 6) AS gain FROM a JOIN b USING (sid, rho)""")
def old_new_results(spark, sf_dir):
    p = priced(spark, sf_dir)
    a, b = (p.where(F.col("predictor") == k).select("sid", "rho", F.col("bits").alias(v)) for k, v in (("lorenzo1", "old"), ("lorenzo2", "new")))
    key = F.split_part(F.concat_ws("|", "sid", F.col("rho").cast("string")), F.lit("|"), F.lit(1))
    return a.join(b, ["sid", "rho"]).select(key.alias("name"), "rho", F.round(100 * (1 - F.col("new") / F.col("old")), 6).alias("gain"))


@query("SELECT event_type AS status, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def registry_summary(spark, sf_dir):
    return views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(f"""{REV}, {TAU}, {M}, {LONG}, actual AS (SELECT 'best|' || predictor AS claim, avg(bits / n) AS value FROM priced GROUP BY predictor UNION ALL SELECT 'samples', count(*) / 3.0 FROM quantized
), claims(claim, paper, tol) AS (VALUES ('best|lorenzo1', 35.0::double, 5.0::double), ('best|lorenzo2', 35.0, 0.1), ('samples', 7497.0, 0.15), ('missing', 1.0, 1.0))
SELECT claim, paper, round(value, 6) AS actual, coalesce(abs(paper - value) <= tol, false) AS good FROM claims LEFT JOIN actual USING (claim)""")
def claim_verification(spark, sf_dir):
    """Stated values against computed ones, with a tolerance each; a claim without a value fails."""
    claims = spark.createDataFrame([("best|lorenzo1", 35.0, 5.0), ("best|lorenzo2", 35.0, 0.1), ("samples", 7497.0, 0.15), ("missing", 1.0, 1.0)], "claim string, paper double, tol double")
    mean = priced(spark, sf_dir).groupBy(F.concat(F.lit("best|"), "predictor").alias("claim")).agg(F.avg(F.col("bits") / F.col("n")).alias("value"))
    size = quantized(spark, sf_dir).agg((F.count(F.lit(1)) / 3).alias("value")).select(F.lit("samples").alias("claim"), "value")
    good = F.coalesce(F.abs(F.col("paper") - F.col("value")) <= F.col("tol"), F.lit(False))
    return claims.join(mean.unionByName(size), "claim", "left").select("claim", "paper", F.round("value", 6).alias("actual"), good.alias("good"))


@query(f"""{REV}, {TAU}, {M}, {EMA}, sg AS (SELECT sid, t, v, greatest(coalesce(avg(v) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), 1), 0.001) AS sig FROM q05
), si AS (SELECT sid, greatest(avg(sig), 0.001) AS a FROM sg WHERE t < 256 GROUP BY sid
), rs(sid, t, r) AS (SELECT sid, 0::bigint, a FROM si UNION ALL SELECT rs.sid, rs.t + 1, rs.r + (g.sig - rs.r) / 256 FROM rs JOIN sg g ON g.sid = rs.sid AND g.t = rs.t
), sp AS (SELECT sid, cast(max(v) * 2 + 3 AS double) AS span FROM sg GROUP BY sid
), z AS (SELECT sg.sid, v, span, greatest(greatest(run.r, 0.001) / greatest(greatest(rs.r, 0.001), 1e-9) * sig, 0.001) AS b FROM sg JOIN run USING (sid, t) JOIN rs USING (sid, t) JOIN sp USING (sid)
) SELECT sid, round(avg(-log2(0.9999::double * CASE WHEN v < 0.5 THEN 1 - exp(-(v + 0.5) / b) ELSE 0.5 * (exp(-(v - 0.5) / b) - exp(-(v + 0.5) / b)) END + 0.0001::double / span)), 5) AS bpv FROM z GROUP BY sid""")
def heteroscedastic_bits(spark, sf_dir):
    """Bits of indices under a Laplace scale that follows a spread known beforehand, its gain calibrated as it goes."""
    d = quantized(spark, sf_dir, (0.05,)).select("sid", "t", F.abs("q1").cast("double").alias("v"))
    d = d.withColumn("sig", F.greatest(F.coalesce(F.avg("v").over(by_t().rowsBetween(-16, -1)), F.lit(1.0)), F.lit(1e-3)))
    d = codelength.running_mean(codelength.running_mean(d, "v", 256, "ra"), "sig", 256, "rs")
    b = F.greatest(F.col("ra") / F.greatest(F.col("rs"), F.lit(1e-9)) * F.col("sig"), F.lit(1e-3))
    d = d.select("sid", "v", b.alias("b"), (F.max("v").over(Window.partitionBy("sid")) * 2 + 3).alias("span"))
    p = codelength.escaped(codelength.laplace_mass(F.col("v"), F.lit(0.0), F.col("b")), F.col("span"))
    return d.groupBy("sid").agg(F.round(F.avg(codelength.bits(p)), 5).alias("bpv"))


@query(f"""{REV}, w AS (SELECT sid, t, x, list(x) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS v FROM series)
SELECT sid, t, len(v) AS n, list_sum(v) AS total, len(list_filter(v, lambda a: a <= x)) AS place, list_max(v) AS top FROM w""")
def window_location(spark, sf_dir):
    """Sliding windows of nine samples: their sum, their running maximum's end, and how many are not above the newest."""
    v = F.collect_list("x").over(by_t().rowsBetween(-8, 0))
    d = views.daily_revenue(spark, sf_dir).select("sid", "t", "x", v.alias("v"))
    place = F.size(F.filter("v", lambda a: a <= F.col("x"))).cast("long")
    return d.select("sid", "t", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"), place.alias("place"), F.element_at(codelength.monotone(F.col("v")), -1).alias("top"))


@query(f"{REV}, l AS (SELECT sid, x, lag(x) OVER (PARTITION BY sid ORDER BY t) AS a FROM series) SELECT sid, count(*) AS n, round(regr_slope(x, a), 9) AS slope, round(regr_intercept(x, a), 3) AS intercept FROM l WHERE a IS NOT NULL GROUP BY sid")
def ar1_fit(spark, sf_dir):
    d = views.daily_revenue(spark, sf_dir).select("sid", "x", F.lag("x").over(by_t()).alias("a")).where("a IS NOT NULL")
    return d.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("x", "a"), 9).alias("slope"), F.round(F.regr_intercept("x", "a"), 3).alias("intercept"))


@query(f"""{REV}, {TAU}, {M}, s AS (SELECT sid, t, q1, coalesce(avg(abs(q1)) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), 0) AS sig FROM quantized WHERE rho = 0.05
), e AS (SELECT sid, quantile_cont(sig, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM s GROUP BY sid
) SELECT s.sid, len(list_filter(edges, lambda a: a < sig)) AS bucket, count(*) AS n, cast(sum(abs(q1)) AS bigint) AS mass FROM s JOIN e USING (sid) GROUP BY ALL""")
def spread_buckets(spark, sf_dir):
    """Indices by quantile bucket of the spread before them; a value on an edge belongs below it."""
    d = quantized(spark, sf_dir, (0.05,)).select("sid", "t", "q1", F.coalesce(F.avg(F.abs("q1")).over(by_t().rowsBetween(-16, -1)), F.lit(0.0)).alias("sig"))
    edges = d.groupBy("sid").agg(F.percentile("sig", F.array(*(F.lit(i / 8) for i in range(1, 8)))).alias("edges"))
    b = F.size(F.filter("edges", lambda e: e < F.col("sig"))).cast("long")
    return d.join(edges, "sid").groupBy("sid", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("q1")).alias("mass"))


@query(f"{REV}, {TAU} SELECT sid, rho, cast(regexp_extract('ctx' || cast(cast(rho * 1000 AS int) AS varchar) || '_N', '[0-9]+') AS bigint) AS token, row_number() OVER (PARTITION BY sid ORDER BY cast(regexp_extract('ctx' || cast(cast(rho * 1000 AS int) AS varchar) || '_N', '[0-9]+') AS bigint)) AS place FROM taus")
def numeric_token_order(spark, sf_dir):
    """Rows in the order of a number inside their label, not of its letters."""
    label = F.concat(F.lit("ctx"), F.round(F.col("rho") * 1000).cast("int").cast("string"), F.lit("_N"))
    d = tolerances(views.daily_revenue(spark, sf_dir)).select("sid", "rho", F.regexp_extract(label, "[0-9]+", 0).cast("long").alias("token"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("sid").orderBy("token")).cast("long"))


# --- grouped maps ---


def trailing_quantiles(x: np.ndarray, context: int) -> np.ndarray:
    """Nine quantiles of the `context` samples before each sample from `context` on."""
    windows = np.lib.stride_tricks.sliding_window_view(x, context)[:-1]
    return np.quantile(windows, np.arange(1, 10) / 10, axis=1).T


@query(f"""{REV}, w AS (SELECT sid, t, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS q FROM series)
SELECT sid, t, {", ".join(f"round(q[{i}], 4) AS q{i}0" for i in range(1, 10))} FROM w WHERE t >= 64""")
def forecast_collection(spark, sf_dir):
    """Nine quantiles of the 64 samples before each position, at every position that has them."""

    def work(_sid, x):
        q = trailing_quantiles(x, 64) if len(x) > 64 else np.zeros((0, 9))
        return {"t": np.arange(64, 64 + len(q))} | {f"q{i + 1}0": q[:, i] for i in range(9)}

    found = by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "t long, " + ", ".join(f"q{i}0 double" for i in range(1, 10)))
    return found.select("sid", "t", *(F.round(f"q{i}0", 4).alias(f"q{i}0") for i in range(1, 10)))


def _t3(z):
    u = z / np.sqrt(3)
    return 0.5 + (u / (1 + u * u) + np.arctan(u)) / np.pi


def expert_masses(x: np.ndarray, context: int = 64, order: int = 32, stack: int = 16, adapt: int = 256) -> dict[str, np.ndarray]:
    """Mass of every sample from `context` on under each expert: Laplace and t3 around the trailing median, linear prediction, and blends of past samples with and without the median."""
    q, v = trailing_quantiles(x, context), x[context:]
    at, span, median = np.arange(context, len(x)), x.max() - x.min() + 1, q[:, 4]
    spread = np.maximum(q[:, 8] - q[:, 0], 1e-3)
    out = {f"laplace_{k}": mixture.laplace_at(np.abs(v - median), k * spread / (2 * codelength.LN5)) for k in codelength.LAPLACE_SCALES}
    for k in codelength.T3_SCALES:
        b = np.maximum(k * spread / (2 * codelength.T3_Q90), 1e-3)
        out[f"t3_{k}"] = _t3((v + 0.5 - median) / b) - _t3((v - 0.5 - median) / b)

    def followed(p: np.ndarray, start: int) -> np.ndarray:
        """A Laplace density around predictions from sample `start` on, its scale following their errors."""
        r = np.abs(x[start:] - p)
        return mixture.laplace_at(r, mixture.trailing_mean(r, adapt, 1e-3))[context - start :]

    windows = np.lib.stride_tricks.sliding_window_view(x, order)[:-1]
    out["lpc32"] = followed(np.rint(windows @ predictors.autoregression(x, order)), order)
    past = [np.ones(len(v)), *(x[at - k] for k in range(1, stack + 1))]
    for name, columns in (("stack", [*past, median]), ("stack_nomodel", past)):
        f = np.column_stack(columns)
        out[name] = followed(np.rint(f @ np.linalg.lstsq(f, v, rcond=None)[0]), context)
    return {k: (1 - codelength.ESCAPE) * np.clip(p, 0, 1) + codelength.ESCAPE / span for k, p in out.items()}


@query()
def bayes_mixture_bits(spark, sf_dir):
    """Bits a sample of each expert, of the mixture of all, and of the mixture of those that use no quantile."""

    def work(_sid, x):
        p = expert_masses(x)
        out = {k: float(-np.log2(row).mean()) for k, row in p.items()}
        out["mixture"] = float(mixture.mixture_bits(np.stack(list(p.values())), 0.998).mean())
        out["mixture_classical"] = float(mixture.mixture_bits(np.stack([p["lpc32"], p["stack_nomodel"]]), 0.998).mean())
        return {"expert": np.array(list(out)), "bpv": np.array(list(out.values()))}

    return by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "expert string, bpv double")


_EXPERTS = [*((k, "laplace") for k in codelength.LAPLACE_SCALES), *((k, "t3") for k in codelength.T3_SCALES)]


def _mass_sql(k: float, kind: str) -> str:
    if kind == "laplace":
        b = f"greatest({k}::double * s / {2 * codelength.LN5!r}, 0.001)"
        return f"CASE WHEN r < 0.5 THEN 1 - exp(-(r + 0.5) / {b}) ELSE 0.5 * (exp(-(r - 0.5) / {b}) - exp(-(r + 0.5) / {b})) END"
    b = f"(greatest({k}::double * s / {2 * codelength.T3_Q90!r}, 0.001) * sqrt(3.0::double))"
    side = lambda e: f"((d {e}) / {b} / (1 + ((d {e}) / {b}) * ((d {e}) / {b})) + atan((d {e}) / {b})) / pi()"
    return f"{side('+ 0.5')} - {side('- 0.5')}"


@query(f"""{REV}, w AS (SELECT sid, t, x, quantile_cont(x, [0.1, 0.5, 0.9]) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS q, max(x) OVER (PARTITION BY sid) - min(x) OVER (PARTITION BY sid) + 1 AS span FROM series
), e AS (SELECT sid, t - 64 AS t, span, x - q[2] AS d, abs(x - q[2]) AS r, greatest(q[3] - q[1], 0.001) AS s FROM w WHERE t >= 64
), p AS (SELECT sid, t, list_transform([{", ".join(_mass_sql(*e) for e in _EXPERTS)}], lambda v: 0.9999::double * least(greatest(v, 0), 1) + 0.0001::double / span) AS p FROM e
), run(sid, t, w, mass) AS (SELECT DISTINCT sid, -1::bigint, list_transform(range({len(_EXPERTS)}), lambda i: 1.0::double / {len(_EXPERTS)}), 1.0::double FROM p
  UNION ALL SELECT run.sid, p.t, list_transform(list_zip(run.w, p.p), lambda z: 0.998::double * z[1] * z[2] / list_dot_product(run.w, p.p) + 0.002::double / {len(_EXPERTS)}), list_dot_product(run.w, p.p) FROM run JOIN p ON p.sid = run.sid AND p.t = run.t + 1)
SELECT sid, count(*) AS n, round(avg(-log2(mass)), 6) AS bpv FROM run WHERE t >= 0 GROUP BY sid""")
def quantile_mixture_bits(spark, sf_dir):
    """Bits a sample of the mixture of the twelve experts around the trailing median."""

    def work(_sid, x):
        p = expert_masses(x)
        rows = np.stack([p[f"{kind}_{k}"] for k, kind in _EXPERTS])
        return {"n": np.array([rows.shape[1]]), "bpv": np.array([mixture.mixture_bits(rows, 0.998).mean()])}

    return by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "n long, bpv double").select("sid", "n", F.round("bpv", 6).alias("bpv"))


@query()
def spread_contexts(spark, sf_dir):
    """Range-coded bytes with and without eight spread buckets as contexts, and bucketed streams compressed apart."""

    def work(_sid, _rho, q):
        a = np.abs(q).astype(float)
        before = np.concatenate(([0.0], np.cumsum(a)))
        at = np.arange(len(q))
        spread = (before[at] - before[np.maximum(at - 16, 0)]) / np.maximum(np.minimum(at, 16), 1)
        b = np.searchsorted(np.quantile(spread, np.linspace(0, 1, 9)[1:-1]), spread)
        coded = rangecoder.encode(q, b, 8)
        same = bool((rangecoder.decode(coded, len(q), b, 8) == q).all())
        return {"plain": np.array([len(rangecoder.encode(q))]), "with_contexts": np.array([len(coded)]), "bucketed": np.array([compressors.bucketed_bytes(q, spread, 1.0)]), "same": np.array([same])}

    return by_series(quantized(spark, sf_dir, (0.05,)), ["sid", "rho"], ["q1"], work, "plain long, with_contexts long, bucketed long, same boolean")


@query()
def stride_loop(spark, sf_dir):
    """Closed loops whose forecasts cover 1, 8, 32 and 64 samples: bits a sample, and whether the bound holds."""

    def work(_sid, _rho, x, tau):
        steps, bpv, held = [1, 8, 32, 64], [], []
        for s in steps:
            q, xhat = predictors.closed_loop(x, float(tau[0]), predictors.SeasonalLag(7), 512, s)
            bpv.append(rangecoder.code_length(q) / max(1, len(x)))
            held.append(bool(np.abs(xhat - x).max() <= tau[0] + 1e-6))
        return {"stride": np.array(steps), "bpv": np.array(bpv), "held": np.array(held)}

    return by_series(with_tau(views.daily_revenue(spark, sf_dir), (0.05,)), ["sid", "rho"], ["x", "tau"], work, "stride long, bpv double, held boolean")


@query()
def synthetic_meta(spark, sf_dir):
    """Length, range and distinct values of the ten synthetic series; sf_dir is not used."""
    from ..sources import synthetic

    return synthetic.meta(synthetic.corpus(spark))


@query()
def classical_code_lengths(spark, sf_dir):
    """Bits a sample of the classical ideal codes: order 0, differences, linear prediction of orders 8 and 32."""

    def work(_sid, x):
        n = max(1, len(x))
        out = {"order0": mixture.order0(x), "delta": mixture.order0(np.diff(x, prepend=x[:1])), "linear8": mixture.linear_laplace(x, 8), "linear32": mixture.linear_laplace(x, 32)}
        return {"code": np.array(list(out)), "bpv": np.array(list(out.values())) / n}

    return by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "code string, bpv double")


def _recalibrated_sql() -> str:
    lap = lambda b: f"CASE WHEN r < 0.5 THEN 1 - exp(-(r + 0.5) / {b}) ELSE 0.5 * (exp(-(r - 0.5) / {b}) - exp(-(r + 0.5) / {b})) END"
    u = lambda e: f"((d {e}) / (bt * sqrt(3.0::double)))"
    t3 = f"({u('+ 0.5')} / (1 + {u('+ 0.5')} * {u('+ 0.5')}) + atan({u('+ 0.5')}) - {u('- 0.5')} / (1 + {u('- 0.5')} * {u('- 0.5')}) - atan({u('- 0.5')})) / pi()"
    cost = lambda p: f"round(avg(-log2(0.9999::double * least(greatest({p}, 0), 1) + 0.0001::double / span)), 6)"
    return f"""{REV}, w AS (SELECT sid, t, x, quantile_cont(x, [0.1, 0.5, 0.9]) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS q, max(x) OVER (PARTITION BY sid) - min(x) OVER (PARTITION BY sid) + 1 AS span FROM series
), e AS (SELECT sid, t - 64 AS t, span, x - q[2] AS d, abs(x - q[2]) AS r, greatest((q[3] - q[1]) / {2 * codelength.LN5!r}, 0.001) AS s FROM w WHERE t >= 64
), i AS (SELECT sid, greatest(avg(r), 0.001) AS a, greatest(avg(s), 0.001) AS b FROM e WHERE t < 256 GROUP BY sid
), run(sid, t, a, b) AS (SELECT sid, 0::bigint, a, b FROM i UNION ALL SELECT run.sid, run.t + 1, run.a + (e.r - run.a) / 256, run.b + (e.s - run.b) / 256 FROM run JOIN e ON e.sid = run.sid AND e.t = run.t
), z AS (SELECT sid, span, d, r, greatest(a, 0.001) AS b1, greatest(greatest(a, 0.001) / greatest(b, 0.001) * s, 0.001) AS b2, greatest(greatest(a, 0.001) / greatest(b, 0.001) * s * {codelength.LN5 / codelength.T3_Q90!r}, 0.001) AS bt FROM run JOIN e USING (sid, t))
SELECT sid, {cost(lap("b1"))} AS even, {cost(lap("b2"))} AS shaped, {cost(t3)} AS shaped_t3 FROM z GROUP BY sid"""


@query(_recalibrated_sql())
def recalibrated_expert_bits(spark, sf_dir):
    """Experts around trailing quantiles whose scale is recalibrated as it goes: even, by the model's shape, and with t3 tails."""
    w = by_t().rowsBetween(-64, -1)
    d = views.daily_revenue(spark, sf_dir)
    q = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).over(w)
    span = F.max("x").over(Window.partitionBy("sid")) - F.min("x").over(Window.partitionBy("sid")) + 1
    d = d.select("sid", "t", "x", q.alias("q"), span.alias("span")).where("t >= 64").withColumn("t", F.col("t") - 64)
    d = d.select("sid", "t", "x", "span", F.col("q")[1].alias("med"), F.greatest((F.col("q")[2] - F.col("q")[0]) / (2 * codelength.LN5), F.lit(1e-3)).alias("s"))
    d = d.withColumn("r", F.abs(F.col("x") - F.col("med")))
    d = codelength.running_mean(codelength.running_mean(d, "r", 256, "ra"), "s", 256, "sa").withColumn("scale", F.col("ra") / F.col("sa") * F.col("s"))
    mean = lambda p: F.round(F.avg(codelength.bits(codelength.escaped(p, F.col("span")))), 6)
    x, med = F.col("x"), F.col("med")
    return d.groupBy("sid").agg(
        mean(codelength.laplace_mass(x, med, F.col("ra"))).alias("even"),
        mean(codelength.laplace_mass(x, med, F.col("scale"))).alias("shaped"),
        mean(codelength.t3_mass(x, med, F.col("scale") * (codelength.LN5 / codelength.T3_Q90))).alias("shaped_t3"),
    )
