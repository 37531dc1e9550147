"""The comparison workload: gains over the best of six classical quantizers, and what conditioning and hybrids bring.

The quantizer that is compared is the closed loop of a weekly seasonal lag (a registered forecaster like any
other); every index stream is coded by one back end. Series are cut to `N` samples from `START` on, their
bounds follow from the whole series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerance import with_tau
from ..operators import compressors, interpolate, lorenzo, mixture, predictors, rangecoder
from ..operators.grouped import by_series
from ..sources import series as views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
START, N, HEADER = 128, 2048, 24
#: Lags of the seasonal regressions (days instead of the hours of other corpora).
LAG_SETS = {
    "lpc32": [*range(1, 33)],
    "lpc168": [*range(1, 169)],
    "lpc336": [*range(1, 337)],
    "seasonal24": [*range(1, 25), 47, 48, 49, 71, 72, 73, 167, 168, 169, 335, 336, 337],
    "seasonal_big": [
        *range(1, 49), 71, 72, 73, 95, 96, 97, 119, 120, 121, 143, 144, 145, 166, 167, 168, 169, 170, 334, 335, 336, 337, 338, 504, 505, 506, 672, 673, 674,
    ],
}
SEASONS = [*range(1, 49), 71, 72, 73, 95, 96, 97, 119, 120, 121, 167, 168, 169, 335, 336, 337, 503, 504, 505, 671, 672, 673]


def query(f):
    QUERIES[f.__name__] = f
    return f


def corpora(spark, sf_dir) -> DataFrame:
    """(corpus, sid, t, x) of three corpora."""
    parts = {"revenue": views.daily_revenue, "orders": views.daily_orders, "events": views.hourly_events}
    every = [f(spark, sf_dir).select(F.lit(name).alias("corpus"), F.concat_ws("/", F.lit(name), "sid").alias("sid"), "t", "x") for name, f in parts.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


def coded(q: np.ndarray) -> float:
    return 8 * (len(rangecoder.encode(q)) + HEADER) / len(q)


def packed(q: np.ndarray) -> float:
    return 8 * compressors.best_bytes(q, HEADER) / len(q)


def scores(spark, sf_dir) -> DataFrame:
    """(corpus, sid, rho, classic, model, old_classic, old_model): bits a sample under the range coder, and under general compressors ("old")."""

    def work(_corpus, _sid, _rho, x, tau):
        x, bound = x[START : START + N], float(tau[0])
        if not len(x):
            return {k: np.zeros(0) for k in ("classic", "model", "old_classic", "old_model")}
        classic = [f(x, bound)[0] for f in predictors.CLASSICAL.values()]
        q, _ = predictors.closed_loop(x, bound, predictors.SeasonalLag(7))
        return {"classic": np.array([min(map(coded, classic))]), "model": np.array([coded(q)]), "old_classic": np.array([min(map(packed, classic))]), "old_model": np.array([packed(q)])}

    rows = corpora(spark, sf_dir)
    bounded = with_tau(rows.select("sid", "t", "x")).withColumn("corpus", F.split_part("sid", F.lit("/"), F.lit(1)))
    return by_series(bounded, ["corpus", "sid", "rho"], ["x", "tau"], work, "classic double, model double, old_classic double, old_model double")


def gain(model="model", classic="classic"):
    return 100 * (1 - F.col(model) / F.col(classic))


def _summary(g: str = "gain"):
    return [F.round(F.median(g), 6).alias("median"), F.round(F.avg(g), 6).alias("mean"), F.count_if(F.col(g) > 0).alias("wins"), F.count(F.lit(1)).alias("n")]


@query
def gain_by_corpus(spark, sf_dir):
    """Gain over the best of six by corpus, over all corpora ("all"), and over the two of demand ("demand")."""
    g = scores(spark, sf_dir).select("corpus", gain().alias("gain"))
    groups = F.array(F.col("corpus"), F.lit("all"), F.when(F.col("corpus") != "events", F.lit("demand")))
    return g.select(F.explode(F.array_compact(groups)).alias("corpus"), "gain").groupBy("corpus").agg(*_summary())


@query
def gain_by_domain_rho(spark, sf_dir):
    """Mean bits of both sides, median gain and wins by corpus and rho, beside the median under general compressors."""
    s = scores(spark, sf_dir).withColumn("gain", gain()).withColumn("old", gain("old_model", "old_classic"))
    return s.groupBy("corpus", "rho").agg(F.round(F.avg("classic"), 6).alias("classic"), F.round(F.avg("model"), 6).alias("model"), *_summary(), F.round(F.median("old"), 6).alias("old_median"))


@query
def gain_percentiles(spark, sf_dir):
    """Quartiles of the gain by corpus and rho, with the series of the least and the greatest."""
    g = scores(spark, sf_dir).select("corpus", "rho", "sid", gain().alias("gain"))
    return g.groupBy("corpus", "rho").agg(
        F.round(F.percentile("gain", 0.25), 6).alias("p25"), F.round(F.percentile("gain", 0.75), 6).alias("p75"),
        F.min_by("sid", F.struct("gain", "sid")).alias("worst"), F.max_by("sid", F.struct("gain", "sid")).alias("best"), F.count(F.lit(1)).alias("n"),
    )


@query
def seasonal_lag_bits(spark, sf_dir):
    """Bits a sample of five regressions on lags under an adaptive Laplace density, 32 bits for each weight; a series too short for a set has none."""

    def work(_sid, x):
        found = {k: mixture.lag_laplace(x, v) for k, v in LAG_SETS.items() if len(x) > 2 * max(v)}
        return {"lags": np.array(list(found), dtype=object), "bpv": np.array(list(found.values()), float)}

    return by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "lags string, bpv double")


@query
def fair_lossless_comparison(spark, sf_dir):
    """Six predictors of whole samples under the shared residual coder: trailing median, linear of two orders, seasonal lags, and blends with and without the median."""
    context = 64

    def work(_sid, x):
        span = float(np.ptp(x) + 1)
        at = np.arange(max(SEASONS), len(x))  # positions that all candidates share
        median = np.median(np.lib.stride_tricks.sliding_window_view(x, context)[:-1], axis=1)[at - context]
        blend = lambda cols: np.rint(np.column_stack(cols) @ np.linalg.lstsq(np.column_stack(cols), x[at], rcond=None)[0])
        past = [np.ones(len(at)), *(x[at - k] for k in range(1, 17))]
        of = lambda lags: predictors.lag_fit(x, lags)[0][at - max(lags)]
        predicted = {"median": np.rint(median), "lpc32": of([*range(1, 33)]), "lpc256": of([*range(1, 257)]), "seasonal": of(SEASONS), "stack": blend([*past, median]), "stack_nomodel": blend(past)}
        bits = {k: float(mixture.fair_bits(x[at] - p, span).mean()) for k, p in predicted.items()}
        least = min(v for k, v in bits.items() if k not in ("median", "stack"))
        return {"model": np.array(list(bits)), "bpv": np.array(list(bits.values())), "gain": 100 * (1 - np.array(list(bits.values())) / least)}

    return by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "model string, bpv double, gain double")


@query
def cross_channel_bits(spark, sf_dir):
    """Bits a sample of a series given its own past, and given another series' past and present too, for each ordered pair."""
    lags = range(1, 17)

    def work(_sid, _other, x, cov):
        at = np.arange(max(lags), len(x))
        own = [np.ones(len(at)), *(x[at - k] for k in lags)]
        out = {}
        for name, cols in (("alone", own), ("conditioned", [*own, cov[at], *(cov[at - k] for k in lags)])):
            f = np.column_stack(cols)
            out[name] = float(mixture.fair_bits(x[at] - np.rint(f @ np.linalg.lstsq(f, x[at], rcond=None)[0]), float(np.ptp(x) + 1)).mean())
        return {k: np.array([v]) for k, v in out.items()} | {"gain": np.array([100 * (1 - out["conditioned"] / out["alone"])])}

    s = views.daily_revenue(spark, sf_dir)
    pairs = s.join(s.select(F.col("sid").alias("other"), "t", F.col("x").alias("cov")), "t").where("sid <> other")
    return by_series(pairs.select("sid", "other", "t", "x", "cov"), ["sid", "other"], ["x", "cov"], work, "alone double, conditioned double, gain double")


@query
def hybrid_comparison(spark, sf_dir):
    """Mean bits by rho of two predictors, cubic interpolation and the two hybrids, and the better hybrid's gain over the best of the rest."""
    kinds = ("seasonal", "lorenzo2", "interp_cubic", "blend", "leader")

    def work(_sid, _rho, x, tau):
        bound, week, second = float(tau[0]), predictors.SeasonalLag(7), predictors.Linear([-1, 2])
        streams = {
            "seasonal": predictors.closed_loop(x, bound, week)[0], "lorenzo2": lorenzo.closed_loop(x, bound, 2)[0], "interp_cubic": interpolate.encode(x, bound, "cubic")[2],
            "blend": predictors.hybrid(x, bound, "blend", week, second)[0], "leader": predictors.hybrid(x, bound, "leader", week, second)[0],
        }
        return {k: np.array([packed(streams[k])]) for k in kinds}

    each = by_series(with_tau(views.daily_revenue(spark, sf_dir)), ["sid", "rho"], ["x", "tau"], work, ", ".join(f"{k} double" for k in kinds))
    mean = each.groupBy("rho").agg(*(F.avg(k).alias(k) for k in kinds))
    better, base = F.least("blend", "leader"), F.least("seasonal", "lorenzo2", "interp_cubic")
    return mean.select("rho", *(F.round(k, 6).alias(k) for k in kinds), F.round(100 * (1 - better / base), 6).alias("gain"))


REV = f"WITH {views.REVENUE_SQL}"
_COARSE = """k AS (SELECT s.sid, s.t, s.x, 2 * p.tau AS d, cast(round_even(s.x / (2 * p.tau), 0) AS bigint) AS m FROM series s JOIN taus p USING (sid) WHERE s.t % 16 = 0"""


@query
def two_level_coarse(spark, sf_dir):
    """The coarse layer of two-level interpolation: every sixteenth sample as differences on the lattice, and the line to the next at mid-way."""
    from pyspark.sql import Window

    w = Window.partitionBy("sid").orderBy("t")
    d = with_tau(views.daily_revenue(spark, sf_dir), (0.05,)).where("t % 16 = 0").withColumn("m", lorenzo.lattice(F.col("x"), F.col("tau")))
    line = (F.col("m") + F.coalesce(F.lead("m").over(w), F.col("m"))) * F.col("tau")
    return d.select("sid", "t", (F.col("m") - F.lag("m", 1, 0).over(w)).alias("q"), F.round(line, 4).alias("midway"))


def _register_sql() -> None:
    from ..functions.tolerance import tau_sql

    ORACLE_SQL["two_level_coarse"] = f"""{REV}, {tau_sql((0.05,))}, {_COARSE}) SELECT sid, t, m - lag(m, 1, 0) OVER w AS q, round((m + coalesce(lead(m) OVER w, m)) * d / 2, 4) AS midway FROM k WINDOW w AS (PARTITION BY sid ORDER BY t)"""


_register_sql()


@query
def supplier_prices(spark, sf_dir):
    """Order-0 bits of the difference predictors on a view whose number of series grows with the data: revenue by supplier and day."""
    from ..functions.codelength import order0_bits

    q = lorenzo.long_form(lorenzo.indices(with_tau(views.supplier_revenue(spark, sf_dir), (0.05,))))
    p = order0_bits(q, ["sid", "rho", "predictor"], "q")
    return p.select("sid", "rho", "predictor", "n", F.round("bits", 3).alias("bits"))


def _supplier_sql() -> None:
    from ..functions.tolerance import tau_sql
    from .series_queries import LONG, M

    ORACLE_SQL["supplier_prices"] = f"WITH {views.SUPPLIER_SQL}, {tau_sql((0.05,))}, {M}, {LONG} SELECT sid, rho, predictor, n, round(bits, 3) AS bits FROM priced"


_supplier_sql()


BASELINES = ("order0", "delta", "linear8", "linear32", *(f"{m}_{layout}" for m in ("xz", "bz2", "zstd") for layout in ("raw", "raw_shuffled", "delta", "delta_shuffled")))


@query
def all_baselines(spark, sf_dir):
    """Bits a sample of ideal codes and general compressors on whole samples, a column each, and the best of them."""

    def work(_sid, x):
        ideal = {"order0": mixture.order0(x), "delta": mixture.order0(np.diff(x, prepend=x[:1])), "linear8": mixture.linear_laplace(x, 8), "linear32": mixture.linear_laplace(x, 32)}
        found = ideal | {k: 8.0 * v for k, v in compressors.sizes(x).items()}
        return {"method": np.array(list(found)), "bpv": np.array(list(found.values())) / max(1, len(x))}

    each = by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "method string, bpv double").where(F.col("method").isin(*BASELINES))
    best = each.groupBy("sid").agg(F.min_by("method", F.struct("bpv", "method")).alias("best"))
    return each.groupBy("sid").pivot("method", list(BASELINES)).agg(F.first("bpv")).join(best, "sid")


@query
def noise_gain_fitted(spark, sf_dir):
    """Noise gain of fitted linear predictors: the norm of their weights."""

    def work(_sid, x):
        orders = [1, 2, 8, 32]
        return {"n_weights": np.array(orders), "weights": [predictors.autoregression(x, k).tolist() for k in orders]}

    fitted = by_series(views.daily_revenue(spark, sf_dir), ["sid"], ["x"], work, "n_weights long, weights array<double>")
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))
    return fitted.select("sid", "n_weights", norm.alias("gain"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"))


@query
def lpc32_from_context(spark, sf_dir):
    """Linear prediction in a closed loop from sample 512 on, the samples before it taken as they are: indices and the worst error."""

    def work(_sid, _rho, x, tau):
        q, xhat = predictors.lpc_from(x, float(tau[0]), 512)
        return {"n": np.array([max(0, len(x) - 512)]), "bits": np.array([rangecoder.code_length(q[512:])]), "held": np.array([bool(np.abs(xhat - x).max() <= tau[0] + 1e-6)])}

    return by_series(with_tau(views.daily_revenue(spark, sf_dir), (0.05,)), ["sid", "rho"], ["x", "tau"], work, "n long, bits double, held boolean")
