"""Multilevel interpolation: a coarse grid of anchors, then midpoints level by level.

Samples of one level depend only on coarser levels, so each level is one vector operation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .grouped import by_series


def levels_of(n: int) -> int:
    """The coarsest step is 2 to this power."""
    return max(int(np.floor(np.log2(max(n - 1, 2)))), 1)


def _predicted(xhat: np.ndarray, at: np.ndarray, half: int, cubic: bool) -> np.ndarray:
    n = len(xhat)
    left, right = xhat[at - half], xhat[np.minimum(at + half, n - 1)]
    p = np.where(at + half < n, 0.5 * (left + right), left)
    if cubic:
        full = (at - 3 * half >= 0) & (at + 3 * half < n)
        a = at[full]
        p[full] = (-xhat[a - 3 * half] + 9 * xhat[a - half] + 9 * xhat[a + half] - xhat[a + 3 * half]) / 16
    return p


def _steps(n: int):
    """(half, positions) of every level, coarse to fine."""
    half = 2 ** levels_of(n) // 2
    while half >= 1:
        yield half, np.arange(half, n, 2 * half)
        half //= 2


def encode(x: np.ndarray, tau: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(level, t, q, xhat) in stream order; level 0 are the anchors, which are coded as differences."""
    n, step = len(x), 2 * tau
    xhat, q = np.zeros(n), np.zeros(n, np.int64)
    anchors = np.arange(0, n, 2 ** levels_of(n)) if n else np.zeros(0, np.int64)
    before, order, level = 0.0, [anchors], [np.zeros(len(anchors), np.int64)]
    for i in anchors:
        q[i] = int(np.rint((x[i] - before) / step))
        before = xhat[i] = before + q[i] * step
    for k, (half, at) in enumerate(_steps(n), 1):
        if len(at):
            p = _predicted(xhat, at, half, kind == "cubic")
            q[at] = np.rint((x[at] - p) / step).astype(np.int64)
            xhat[at] = p + q[at] * step
            order.append(at)
            level.append(np.full(len(at), k))
    t = np.concatenate(order)
    return np.concatenate(level), t, q[t], xhat[t]


def decode(q: np.ndarray, tau: float, kind: str) -> np.ndarray:
    """The reconstruction from indices in stream order."""
    n, step = len(q), 2 * tau
    xhat, at0 = np.zeros(n), 0
    before = 0.0
    for i in range(0, n, 2 ** levels_of(n)) if n else ():
        before = xhat[i] = before + q[at0] * step
        at0 += 1
    for half, at in _steps(n):
        if len(at):
            xhat[at] = _predicted(xhat, at, half, kind == "cubic") + q[at0 : at0 + len(at)] * step
            at0 += len(at)
    return xhat


def indices(rows: DataFrame, kind: str, keys=("sid", "rho")) -> DataFrame:
    """(keys, level, t, q, xhat) of rows (keys, t, x, tau)."""

    def work(*columns):
        x, tau = columns[-2:]
        level, t, q, xhat = encode(x, float(tau[0]), kind)
        return {"level": level.astype(np.int32), "t": t, "q": q, "xhat": xhat}

    return by_series(rows, list(keys), ["x", "tau"], work, "level int, t long, q long, xhat double")
