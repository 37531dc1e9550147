"""Groups of series as one binary container: header, bounds, seeds, bodies.

Little-endian: magic, int64 x 4 (series, samples, seed samples, context), float64 bounds; for each series a
seed block (int64 x 5: bytes, 0, 0, seed encoder, indices; then range-coded indices), then for each series
a body block (int64 x 3: bytes, 0, 0; then range-coded indices). Seeds are coded by the cheapest of five
encoders, bodies in a closed loop of a predictor that a decoder must know. Series shorter than the context
have a seed alone.
"""

from __future__ import annotations

import struct

import numpy as np

from . import interpolate, lorenzo, rangecoder
from .predictors import Predictor, closed_loop, replay

MAGIC = b"TFMC2"  # fixed value of the format
HEAD, SEED, BODY = struct.Struct("<4q"), struct.Struct("<5q"), struct.Struct("<3q")


def _seed_forms(x: np.ndarray, tau: float):
    for k in (1, 2, 3):
        q, xhat = lorenzo.closed_loop(x, tau, k)
        yield q, xhat
    for kind in ("linear", "cubic"):
        _, t, q, xhat = interpolate.encode(x, tau, kind)
        out = np.zeros(len(x))
        out[t] = xhat
        yield q, out


def _seed_back(form: int, q: np.ndarray, tau: float) -> np.ndarray:
    if form >= 3:
        return interpolate.decode(q, tau, ("linear", "cubic")[form - 3])
    xhat, step = np.zeros(len(q)), 2 * tau
    for i, k in enumerate(q):
        p = sum(c * xhat[i - 1 - j] for j, c in enumerate(lorenzo.WEIGHTS[form + 1]) if i - 1 - j >= 0)
        xhat[i] = p + k * step
    return xhat


def encode(series: list[np.ndarray], taus: list[float], predictor: Predictor, context: int = 512) -> tuple[bytes, list[np.ndarray]]:
    """(container, reconstructions) of series of one length."""
    if len({len(x) for x in series}) > 1:
        raise ValueError("series of one group must have one length")
    n = len(series[0]) if series else 0
    seed = min(context, n)
    seeds, bodies, out = [], [], []
    for x, tau in zip(series, taus, strict=True):
        forms = [(rangecoder.encode(q), q, xhat) for q, xhat in _seed_forms(np.asarray(x[:seed], float), tau)]
        best = min(range(len(forms)), key=lambda i: len(forms[i][0]))
        blob, q, first = forms[best]
        seeds.append(SEED.pack(len(blob), 0, 0, best, len(q)) + blob)
        q, xhat = closed_loop(np.asarray(x, float), tau, predictor, context, seed=first)
        blob = rangecoder.encode(q[seed:])
        bodies.append(BODY.pack(len(blob), 0, 0) + blob)
        out.append(xhat)
    head = MAGIC + HEAD.pack(len(series), n, seed, context) + np.asarray(taus, "<f8").tobytes()
    return head + b"".join(seeds) + b"".join(bodies), out


def blocks(data: bytes) -> list[dict]:
    """The blocks of a container, without decoding them."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a container")
    at = len(MAGIC)
    count, n, seed, context = HEAD.unpack_from(data, at)
    at += HEAD.size
    taus = np.frombuffer(data, "<f8", count, at).tolist()
    at += 8 * count
    out = []
    for part, form in (("seed", SEED), ("body", BODY)):
        for g in range(count):
            size, _, _, *rest = form.unpack_from(data, at)
            at += form.size
            out.append({"g": g, "part": part, "tau": taus[g], "n": n, "seed": seed, "context": context, "form": rest[0] if rest else None, "count": rest[1] if rest else n - seed, "payload": data[at : at + size]})
            at += size
    return out


def decode(data: bytes, predictor: Predictor) -> list[np.ndarray]:
    found = blocks(data)
    out = []
    for first, rest in zip((b for b in found if b["part"] == "seed"), [b for b in found if b["part"] == "body"], strict=True):
        seed = _seed_back(first["form"], rangecoder.decode(first["payload"], first["count"]), first["tau"])
        q = np.concatenate((np.zeros(first["seed"], np.int64), rangecoder.decode(rest["payload"], rest["count"])))
        out.append(replay(q, first["tau"], predictor, first["context"], seed=seed))
    return out
