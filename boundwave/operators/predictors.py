"""Closed-loop prediction with exchangeable predictors, least squares, and hybrids of two predictors."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np

from . import interpolate, lorenzo

FRACTION = 16384  # coefficients keep 14 fractional bits


class Predictor(Protocol):
    """Forecasts the next samples from the reconstructed past."""

    def forecast(self, past: np.ndarray, horizon: int) -> np.ndarray: ...


class Last:
    def forecast(self, past: np.ndarray, horizon: int) -> np.ndarray:
        return np.full(horizon, past[-1] if len(past) else 0.0)


class SeasonalLag:
    def __init__(self, lag: int):
        self.lag = lag

    def forecast(self, past: np.ndarray, horizon: int) -> np.ndarray:
        if len(past) < self.lag:
            return Last().forecast(past, horizon)
        return np.array([past[len(past) - self.lag + k % self.lag] for k in range(horizon)])


class Linear:
    """Fixed weights on the last samples, the oldest first; a short past meets the last weights."""

    def __init__(self, weights):
        self.weights = np.asarray(weights, float)

    def forecast(self, past: np.ndarray, horizon: int) -> np.ndarray:
        held, out = list(past[-len(self.weights) :]), []
        for _ in range(horizon):
            tail = held[-len(self.weights) :]
            out.append(float(np.dot(self.weights[len(self.weights) - len(tail) :], tail)) if tail else 0.0)
            held.append(out[-1])
        return np.array(out)


def external(name: str, **options) -> Predictor:
    """A forecaster of an installed module `name` with a factory `predictor(**options)`; ImportError where it is absent."""
    import importlib

    return importlib.import_module(name).predictor(**options)


#: Predictors by name; a factory gets options and returns a Predictor.
REGISTRY: dict[str, Callable[..., Predictor]] = {"last": Last, "seasonal_lag": SeasonalLag, "linear": Linear, "external": external}


def rounded(c: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(c) * FRACTION) / FRACTION


def autoregression(x: np.ndarray, order: int) -> np.ndarray:
    """Least-squares weights of the last `order` samples (oldest first), without intercept, rounded."""
    if len(x) <= order:
        return np.zeros(order)
    windows = np.lib.stride_tricks.sliding_window_view(x, order)[:-1]
    return rounded(np.linalg.lstsq(windows, x[order:], rcond=None)[0])


def lagged(x: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(design with an intercept, target) from the first sample that has all lags."""
    top = max(lags)
    return np.column_stack([np.ones(max(0, len(x) - top)), *(x[top - k : len(x) - k] for k in lags)]), x[top:]


def lag_fit(x: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rounded prediction, residual) of least squares on arbitrary lags and an intercept."""
    design, y = lagged(x, lags)
    if not len(y):
        return np.zeros(0), np.zeros(0)
    p = np.rint(design @ np.linalg.lstsq(design, y, rcond=None)[0])
    return p, y - p


def stacked(x: np.ndarray, median: np.ndarray | None, lags: int = 16) -> np.ndarray:
    """Residuals of a least-squares blend of an intercept, `lags` past samples and, if given, a forecast."""
    design, y = lagged(x, list(range(1, lags + 1)))
    if median is not None:
        design = np.column_stack([design, median[lags:]])
    return y - np.rint(design @ np.linalg.lstsq(design, y, rcond=None)[0])


def closed_loop(x: np.ndarray, tau: float, predictor: Predictor, context: int = 512, stride: int = 1, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(q, xhat) with each forecast of `stride` samples made from at most `context` reconstructions.

    `seed`: reconstructions of the first samples, which are then not coded."""
    n, step = len(x), 2 * tau
    xhat, q = np.zeros(n), np.zeros(n, np.int64)
    at = 0 if seed is None else min(n, len(seed))
    if at:
        xhat[:at] = seed[:at]
    while at < n:
        size = min(stride, n - at)
        p = predictor.forecast(xhat[max(0, at - context) : at], size)
        q[at : at + size] = np.rint((x[at : at + size] - p) / step).astype(np.int64)
        xhat[at : at + size] = p + q[at : at + size] * step
        at += size
    return q, xhat


def replay(q: np.ndarray, tau: float, predictor: Predictor, context: int = 512, stride: int = 1, seed: np.ndarray | None = None) -> np.ndarray:
    """The reconstruction from the indices of `closed_loop`."""
    n, step = len(q), 2 * tau
    xhat = np.zeros(n)
    at = 0 if seed is None else min(n, len(seed))
    if at:
        xhat[:at] = seed[:at]
    while at < n:
        size = min(stride, n - at)
        xhat[at : at + size] = predictor.forecast(xhat[max(0, at - context) : at], size) + q[at : at + size] * step
        at += size
    return xhat


def lpc(x: np.ndarray, tau: float, order: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Closed loop with weights fitted to the series itself."""
    return closed_loop(x, tau, Linear(autoregression(x, order)), context=order)


def lpc_from(x: np.ndarray, tau: float, start: int, order: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The same from sample `start` on, before which the past is the series itself."""
    return closed_loop(x, tau, Linear(autoregression(x, order)), context=order, seed=x[:start])


def hybrid(x: np.ndarray, tau: float, mode: str, one: Predictor, two: Predictor, adapt: int = 256, block: int = 256, context: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Two predictors on one reconstruction: "blend" by their running errors, or "leader" of the block before."""
    n, step = len(x), 2 * tau
    xhat, q = np.zeros(n), np.zeros(n, np.int64)
    e1 = e2 = 1.0
    b1 = b2 = 0.0
    first = True
    for t in range(n):
        past = xhat[max(0, t - context) : t]
        p1, p2 = float(one.forecast(past, 1)[0]), float(two.forecast(past, 1)[0])
        if mode == "blend":
            w = e2 / max(e1 + e2, 1e-9)
            p = w * p1 + (1 - w) * p2
        else:
            p = p1 if first else p2
        q[t] = int(np.rint((x[t] - p) / step))
        xhat[t] = p + q[t] * step
        a1, a2 = abs(x[t] - p1), abs(x[t] - p2)
        e1, e2 = e1 + (a1 - e1) / adapt, e2 + (a2 - e2) / adapt
        b1, b2 = b1 + a1, b2 + a2
        if (t + 1) % block == 0:
            first, b1, b2 = b1 <= b2, 0.0, 0.0
    return q, xhat


def two_level(x: np.ndarray, tau: float, keep: int, fine: Predictor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coarse q, fine q, xhat): every `keep`-th sample as differences, the rest against the mean of their line and `fine`."""
    n, step = len(x), 2 * tau
    at = np.arange(0, n, keep)
    m = np.rint(x[at] / step).astype(np.int64)
    line = np.interp(np.arange(n), at, m * step) if n else np.zeros(0)
    xhat, q = line.copy(), []
    for t in range(n):
        if t % keep:
            p = 0.5 * (line[t] + float(fine.forecast(xhat[:t], 1)[0]))
            k = int(np.rint((x[t] - p) / step))
            xhat[t] = p + k * step
            q.append(k)
    return np.diff(m, prepend=0), np.array(q, np.int64), xhat


#: The classical quantizers: f(x, tau) -> (indices in stream order, reconstruction).
CLASSICAL: dict[str, Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]] = {
    **{name: (lambda x, tau, k=k: lorenzo.closed_loop(x, tau, k)) for k, name in lorenzo.NAMES.items()},
    "lpc32": lpc,
    "interp_linear": lambda x, tau: interpolate.encode(x, tau, "linear")[2:],
    "interp_cubic": lambda x, tau: interpolate.encode(x, tau, "cubic")[2:],
}


def gain_of(kind: str) -> float:
    """How much a predictor amplifies white noise on its inputs."""
    if kind.startswith("lorenzo"):
        return float(np.linalg.norm(lorenzo.WEIGHTS[int(kind[-1])]))
    return float(np.sqrt(0.5)) if kind == "interp_linear" else float(np.sqrt((2 + 2 * 81) / 256))
