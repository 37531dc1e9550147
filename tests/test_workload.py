"""Queries without SQL against plain definitions, at the smallest scale."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from boundwave.operators import predictors, rangecoder
from boundwave.plans import registry
from boundwave.plans import workload_queries as workload
from boundwave.sources import series as views

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def revenue(spark):
    out = defaultdict(list)
    for r in views.daily_revenue(spark, DIR).orderBy("sid", "t").collect():
        out[r["sid"]].append(r["x"])
    return {k: np.array(v) for k, v in out.items()}


def rows_of(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, DIR).collect()]


def test_gains(spark, monkeypatch):
    monkeypatch.setattr(workload, "N", 300)
    series = defaultdict(list)
    for r in workload.corpora(spark, DIR).orderBy("sid", "t").collect():
        series[r["corpus"], r["sid"]].append(r["x"])
    gains = defaultdict(list)
    for (corpus, _), x in series.items():
        x = np.array(x)
        for rho in (0.01, 0.05, 0.2):
            tau = max(rho * x.std(), 0.5)
            part = x[workload.START : workload.START + 300]
            bits = lambda q: len(rangecoder.encode(q)) + 24
            least = min(bits(f(part, tau)[0]) for f in predictors.CLASSICAL.values())
            xhat, q = [], []
            for t, v in enumerate(part):
                p = xhat[t - 7] if t >= 7 else xhat[-1] if xhat else 0.0
                q.append(round((v - p) / 2 / tau))
                xhat.append(p + q[-1] * 2 * tau)
            gains[corpus, rho].append(100 * (1 - bits(q) / least))
    every = [g for v in gains.values() for g in v]
    got = {r["corpus"]: r for r in rows_of(spark, "gain_by_corpus")}
    assert set(got) == {"revenue", "orders", "events", "all", "demand"} and got["all"]["n"] == len(every)
    assert got["all"]["median"] == pytest.approx(np.median(every), abs=0.05) and got["all"]["wins"] == sum(g > 0 for g in every)
    assert got["demand"]["n"] == sum(len(v) for (c, _), v in gains.items() if c != "events")
    table = rows_of(spark, "gain_by_domain_rho")
    assert len(table) == 9 and all(r["median"] == pytest.approx(np.median(gains[r["corpus"], r["rho"]]), abs=0.05) and math.isfinite(r["old_median"]) for r in table)
    assert all(r["p25"] <= r["p75"] for r in rows_of(spark, "gain_percentiles"))


def adaptive_laplace(x, p, start, header, floor=1e-3):
    """Bits a sample, one after the other."""
    r = [abs(v - q) for v, q in zip(x[start:], p, strict=True)]
    scale, total = max(sum(r[:256]) / len(r[:256]), floor), 0.0
    for e in r:
        b = max(scale, 1e-3)
        mass = 1 - math.exp(-(e + 0.5) / b) if e < 0.5 else 0.5 * (math.exp(-(e - 0.5) / b) - math.exp(-(e + 0.5) / b))
        total -= math.log2((1 - 1e-4) * mass + 1e-4 / (max(x) - min(x) + 1))
        scale += (e - scale) / 256
    return (total + header) / len(r)


def test_seasonal_lags(spark, revenue):
    got = {(r["sid"], r["lags"]): r["bpv"] for r in rows_of(spark, "seasonal_lag_bits")}
    assert {k for _, k in got} == {"lpc32", "lpc168", "lpc336", "seasonal24", "seasonal_big"}
    for name in ("lpc32", "seasonal24"):
        x, lags = revenue["A"], workload.LAG_SETS[name]
        design = np.array([[1.0, *(x[t - k] for k in lags)] for t in range(max(lags), len(x))])
        weights = np.linalg.lstsq(design, x[max(lags) :], rcond=None)[0]
        assert got["A", name] == pytest.approx(adaptive_laplace(x, np.rint(design @ weights), max(lags), 32 * (len(lags) + 1)), abs=1e-6)


def test_linear_prediction_in_a_loop(spark, revenue):
    x = revenue["A"]
    windows = np.array([x[t - 32 : t] for t in range(32, len(x))])
    weights = np.rint(np.linalg.lstsq(windows, x[32:], rcond=None)[0] * 16384) / 16384
    step, xhat, want = 2 * max(0.05 * x.std(), 0.5), [], []
    for v in x:
        past = xhat[-32:]
        p = sum(w * h for w, h in zip(weights[32 - len(past) :], past, strict=True))
        want.append(round((v - p) / step))
        xhat.append(p + want[-1] * step)
    got = [r["q"] for r in sorted(rows_of(spark, "lpc32_closed_loop"), key=lambda r: r["t"]) if r["sid"] == "A"]
    assert np.mean(np.array(got) == want) > 0.999


def test_mixtures_of_experts(spark, revenue):
    from boundwave.plans.analysis_queries import expert_masses

    got = {(r["sid"], r["expert"]): r["bpv"] for r in rows_of(spark, "bayes_mixture_bits")}
    x = revenue["A"]
    p = expert_masses(x)
    for name, members in (("mixture", list(p)), ("mixture_classical", ["lpc32", "stack_nomodel"])):
        w, total = [1 / len(members)] * len(members), 0.0
        for i in range(len(x) - 64):
            joint = [a * p[m][i] for a, m in zip(w, members, strict=True)]
            total -= math.log2(sum(joint))
            w = [0.998 * j / sum(joint) + 0.002 / len(members) for j in joint]
        assert got["A", name] == pytest.approx(total / (len(x) - 64), abs=1e-6)
    median = np.array([np.median(x[t - 64 : t]) for t in range(64, len(x))])
    design = np.column_stack([np.ones(len(median)), *(x[64 - k : len(x) - k] for k in range(1, 17)), median])
    blend = np.rint(design @ np.linalg.lstsq(design, x[64:], rcond=None)[0])
    assert got["A", "stack"] == pytest.approx(adaptive_laplace(x, blend, 64, 0), abs=0.01)


def test_conditioning_and_hybrids(spark):
    pairs = rows_of(spark, "cross_channel_bits")
    assert len(pairs) == 6 and all(r["gain"] == pytest.approx(100 * (1 - r["conditioned"] / r["alone"])) for r in pairs)
    fair = rows_of(spark, "fair_lossless_comparison")
    assert len(fair) == 18 and all(r["bpv"] > 0 for r in fair)
    assert all(min(abs(r["gain"]) for r in fair if r["sid"] == s) == 0 for s in "ANR")  # the best classical one is the measure
    by_rho = {r["rho"]: r for r in rows_of(spark, "hybrid_comparison")}
    assert len(by_rho) == 3
    for r in by_rho.values():
        assert r["gain"] == pytest.approx(100 * (1 - min(r["blend"], r["leader"]) / min(r["seasonal"], r["lorenzo2"], r["interp_cubic"])), abs=1e-3)


def test_spread_contexts_and_strides(spark, revenue):
    assert all(r["same"] for r in rows_of(spark, "spread_contexts"))
    strides = rows_of(spark, "stride_loop")
    assert {r["stride"] for r in strides} == {1, 8, 32, 64} and all(r["held"] for r in strides)
    codes = {(r["sid"], r["code"]): r["bpv"] for r in rows_of(spark, "classical_code_lengths")}
    x = revenue["A"]
    _, n = np.unique(x, return_counts=True)
    assert codes["A", "order0"] == pytest.approx((-(n * np.log2(n / len(x))).sum() + 32 * len(n)) / len(x))
    windows = np.lib.stride_tricks.sliding_window_view(x, 8)[:-1]
    p = np.rint(windows @ predictors.autoregression(x, 8))
    assert codes["A", "linear8"] * len(x) == pytest.approx(adaptive_laplace(x, p, 8, 96 * 8, 0.5) * (len(x) - 8), rel=1e-6)
    meta = {r["sid"]: r for r in rows_of(spark, "synthetic_meta")}
    assert len(meta) == 10 and {r["n"] for r in meta.values()} == {20_000} and meta["iid_noise"]["hi"] == 4095


def test_baselines_and_fitted_gains(spark, revenue):
    import bz2

    from boundwave.operators import compressors

    rows = {r["sid"]: r for r in rows_of(spark, "all_baselines")}
    for sid, r in rows.items():
        x = revenue[sid]
        assert r["bz2_raw"] == pytest.approx(8 * len(bz2.compress(compressors.serialize(x)[0], 9)) / len(x))
        assert r["best"] == min(workload.BASELINES, key=lambda k: r[k])
    for r in rows_of(spark, "noise_gain_fitted"):
        x = revenue[r["sid"]]
        w = predictors.autoregression(x, r["n_weights"])
        assert r["gain"] == pytest.approx(float(np.linalg.norm(w))) and r["total"] == pytest.approx(float(w.sum()))
    assert all(r["held"] and r["n"] == len(revenue[r["sid"]]) - 512 for r in rows_of(spark, "lpc32_from_context"))
