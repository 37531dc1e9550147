"""Adaptive mixtures of code-length models; weights follow the data, step by step."""

from __future__ import annotations

import numpy as np

from ..functions.codelength import ESCAPE, SCALES


def laplace_grid(resid: np.ndarray, scales=SCALES) -> np.ndarray:
    """Mass of each residual's unit interval, a row for each scale."""
    a, b = np.abs(resid)[None, :], np.asarray(scales, float)[:, None]
    top = np.exp(-(a + 0.5) / b)
    return np.where(a < 0.5, 1 - top, 0.5 * (np.exp(-np.maximum((a - 0.5) / b, 0)) - top))


def mixture_bits(p: np.ndarray, gamma: float) -> np.ndarray:
    """Bits of each step under a mixture of experts p[expert, step] whose weights forget by `gamma`."""
    experts, steps = p.shape
    w, mass = np.full(experts, 1 / experts), np.empty(steps)
    for i in range(steps):
        w = w * p[:, i]
        mass[i] = w.sum()
        w = gamma * (w / mass[i]) + (1 - gamma) / experts
    return -np.log2(np.maximum(mass, 1e-300))


def fair_bits(resid: np.ndarray, span: float | None = None, gamma: float = 0.999) -> np.ndarray:
    """The shared residual coder: a grid of Laplace scales and a uniform expert."""
    r = np.rint(np.asarray(resid, float))
    if not len(r):
        return np.zeros(0)
    span = max(2 * np.abs(r).max() + 1, 3.0) if span is None else span
    p = np.vstack([laplace_grid(r), np.full((1, len(r)), 1 / span)])
    return mixture_bits((1 - ESCAPE) * np.clip(p, 0, 1) + ESCAPE / span, gamma)


def trailing_mean(v: np.ndarray, adapt: int, floor: float) -> np.ndarray:
    """Mean of earlier values with forgetting 1 - 1/adapt, begun with the mean of the first `adapt` values or `floor`."""
    out, acc = np.empty(len(v)), max(float(v[:adapt].mean()) if len(v) else 0.0, floor)
    for i, x in enumerate(v):
        out[i] = acc
        acc += (x - acc) / adapt
    return out


def order0(a: np.ndarray) -> float:
    """Empirical entropy and 32 bits for each distinct value."""
    _, c = np.unique(a, return_counts=True)
    return float((c * np.log2(c.sum() / c)).sum() + 32 * len(c)) if len(c) else 0.0


def linear_laplace(x: np.ndarray, order: int, adapt: int = 256) -> float:
    """Linear prediction with a Laplace scale that follows the residuals; 96 bits of header for each weight."""
    from .predictors import autoregression

    if len(x) <= order + 2:
        return order0(x)
    p = np.rint(np.lib.stride_tricks.sliding_window_view(x, order)[:-1] @ autoregression(x, order))
    r = np.abs(x[order:] - p)
    mass, span = laplace_at(r, trailing_mean(r, adapt, 0.5)), x.max() - x.min() + 1
    return float(-np.log2(np.maximum((1 - ESCAPE) * mass + ESCAPE / span, 1e-300)).sum()) + 96 * order


def lag_laplace(x: np.ndarray, lags: list[int], adapt: int = 256) -> float:
    """Bits a sample of a regression on lags whose Laplace scale follows the residuals; 32 bits for each weight."""
    from .predictors import lag_fit

    _, r = lag_fit(x, lags)
    scale = trailing_mean(np.abs(r), adapt, 1e-3)
    mass = laplace_at(np.abs(r), scale)
    return float((-np.log2(np.maximum((1 - ESCAPE) * mass + ESCAPE / (np.ptp(x) + 1), 1e-300))).sum() + 32 * (len(lags) + 1)) / max(1, len(r))


def laplace_at(r: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Mass of the unit interval at distance r >= 0 from the centre, each under its own scale."""
    b = np.maximum(scale, 1e-3)
    top = np.exp(-(r + 0.5) / b)
    return np.where(r < 0.5, 1 - top, 0.5 * (np.exp(-np.maximum((r - 0.5) / b, 0)) - top))
