"""Ten synthetic series, each from a seed of its own, so that any one can be drawn alone."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _levels(x: np.ndarray, levels: int) -> np.ndarray:
    span = x.max() - x.min()
    return np.rint((x - x.min()) / span * (levels - 1)) if span > 0 else np.zeros(len(x))


def _recursive(noise: np.ndarray, keep: float) -> np.ndarray:
    out, v = np.empty(len(noise)), 0.0
    for i, e in enumerate(noise):
        v = keep * v + e
        out[i] = v
    return out


def ar1(r, n):
    return _levels(_recursive(r.standard_normal(n), 0.99), 65536)


def seasonal_metric(r, n):
    t = np.arange(n)
    day, week = (2 * np.pi * t / k for k in (288, 2016))
    bursts = r.random(n) < 0.002
    return _levels(100 + 30 * np.sin(day) + 12 * np.sin(week + 0.7) + 0.004 * t + 3 * r.standard_normal(n) + 25 * bursts, 65536)


def random_walk(r, n):
    return _levels(np.cumsum(r.standard_normal(n)), 65536)


def iid_noise(r, n):
    return r.integers(0, 4096, n).astype(float)


def lorenz(_r, n):
    p, out = np.ones(3), np.empty(n)
    for i in range(n):
        x, y, z = p
        p = p + 0.01 * np.array([10 * (y - x), x * (28 - z) - y, x * y - 8 / 3 * z])
        out[i] = p[0]
    return _levels(out, 65536)


def byte_counter(r, n):
    rate = 5000 + 4000 * np.sin(2 * np.pi * np.arange(n) / 1440)
    return (np.cumsum(r.poisson(rate)) % 2**31).astype(float)


def poisson_counts(r, n):
    return r.poisson(np.maximum(8 * (1 + 0.6 * np.sin(2 * np.pi * np.arange(n) / 500)), 0.05)).astype(float)


#: Fixed values of the heart beat: height, offset and width in seconds of its four waves; samples a second; reach in samples.
WAVES = ((-0.15, -0.03, 0.012), (1.0, 0.0, 0.010), (-0.25, 0.028, 0.014), (0.30, 0.14, 0.055))
RATE, REACH = 250, 120


def ecg_like(r, n):
    t, beats, at = np.arange(n), [], 0.0
    while at < (n - 1) / RATE:
        beats.append(int(at * RATE))
        at += 0.8 + 0.06 * r.standard_normal()
    x = 0.12 * np.sin(t * 2 * np.pi / (4 * RATE))
    for height, offset, width in WAVES:
        centre = np.array(beats, float)[:, None] + offset * RATE
        near = np.array(beats, int)[:, None] + int(offset * RATE) + np.arange(-REACH, REACH)[None, :]
        wave = height * np.exp(-(((near - centre) / (width * RATE)) ** 2))
        inside = (near >= 0) & (near < n)
        np.add.at(x, near[inside], wave[inside])
    return _levels(x + 0.006 * r.standard_normal(n), 4096)


def regime_switch(r, n):
    level, vol, out = 0.0, 1.0, np.empty(n)
    for i in range(n):
        if r.random() < 1 / 1500:
            level, vol = level + 20 * r.standard_normal(), 10 ** r.uniform(-0.5, 1)
        out[i] = level + vol * r.standard_normal()
    return _levels(out, 65536)


def sparse_spiky(r, n):
    starts = np.flatnonzero(r.random(n) < 0.01)
    heights = 100 * r.standard_normal(n)[starts]
    since = np.searchsorted(starts, np.arange(n), side="right") - 1  # the newest spike, whose level alone decays
    level = np.where(since < 0, 0.0, np.append(heights, 0.0)[since] * 0.92 ** (np.arange(n) - np.append(starts, 0)[since] + 1.0))
    return _levels(level + 0.5 * r.standard_normal(n), 65536)


GENERATORS = {f.__name__: f for f in (ar1, seasonal_metric, random_walk, iid_noise, lorenz, byte_counter, poisson_counts, ecg_like, regime_switch, sparse_spiky)}


def corpus(spark: SparkSession, n: int = 20_000, seed: int = 7, names=tuple(GENERATORS)) -> DataFrame:
    """(sid, t, x) of the named generators, one task each."""

    def draw(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                x = GENERATORS[name](np.random.default_rng([seed, zlib.crc32(name.encode())]), n)
                yield pa.RecordBatch.from_pydict({"sid": pa.array([name] * n), "t": np.arange(n), "x": np.asarray(x, float)})

    return spark.createDataFrame([(k,) for k in names], "sid string").repartition(len(names), "sid").mapInArrow(draw, "sid string, t long, x double")


def meta(series: DataFrame) -> DataFrame:
    return series.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.countDistinct("x").alias("uniq"))
