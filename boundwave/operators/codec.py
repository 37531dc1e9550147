"""Compression of DataFrames of series: one group of series, one container."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import container
from .predictors import REGISTRY

BLOB = "group_id string, n_series int, n long, sids array<string>, blob binary, max_error double, worst double"


def compress(series: DataFrame, rho: float = 0.05, floor: float = 0.5, predictor: str = "last", context: int = 512, **options) -> DataFrame:
    """One container for each group of (group_id, sid, t, x); lengths are cut to the group's shortest.

    A group is coded by one task: its series share the loop by format."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("sid", "ascending"), ("t", "ascending")])
        sid, x = np.array(group.column("sid").to_pylist()), group.column("x").to_numpy().astype(float)
        names = list(dict.fromkeys(sid.tolist()))
        n = min(int((sid == s).sum()) for s in names)
        parts = [x[sid == s][:n] for s in names]
        taus = [max(rho * float(np.std(p)), floor) for p in parts]
        blob, out = container.encode(parts, taus, REGISTRY[predictor](**options), context)
        errors = [float(np.abs(a - b).max()) if n else 0.0 for a, b in zip(out, parts, strict=True)]
        return pa.table({
            "group_id": [group.column("group_id")[0].as_py()], "n_series": pa.array([len(parts)], pa.int32()), "n": [n], "sids": [names],
            "blob": [blob], "max_error": [max(errors)], "worst": [max(e / t for e, t in zip(errors, taus, strict=True))],
        })

    return series.select("group_id", "sid", "t", "x").groupBy("group_id").applyInArrow(work, BLOB)


def decompress(blobs: DataFrame, predictor: str = "last", **options) -> DataFrame:
    """(group_id, sid, t, xhat) of containers; where there are no names (`sids`), a series has its number in the container."""
    if "sids" not in blobs.columns:
        blobs = blobs.withColumn("sids", F.lit(None).cast("array<string>"))

    def run(batches):
        for batch in batches:
            for group, sids, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = container.decode(blob.as_py(), REGISTRY[predictor](**options))
                for s, xhat in zip(sids.as_py() or map(str, range(len(found))), found, strict=False):
                    yield pa.RecordBatch.from_pydict({"group_id": [group.as_py()] * len(xhat), "sid": [s] * len(xhat), "t": np.arange(len(xhat)), "xhat": xhat})

    return blobs.select("group_id", "sids", "blob").mapInArrow(run, "group_id string, sid string, t long, xhat double")


def info(blobs: DataFrame) -> DataFrame:
    """One row for each block: its group, series number, part, seed encoder, counts and bytes."""

    @F.udtf(returnType="g int, part string, tau double, n long, seed long, context long, form long, count long, bytes long")
    class Blocks:
        def eval(self, blob: bytes):
            for b in container.blocks(bytes(blob)):
                yield b["g"], b["part"], b["tau"], b["n"], b["seed"], b["context"], b["form"], b["count"], len(b["payload"])

    spark = blobs.sparkSession
    spark.udtf.register("container_blocks", Blocks)
    blobs.createOrReplaceTempView("__blobs")
    return spark.sql("SELECT group_id, b.* FROM __blobs, LATERAL container_blocks(blob) b")


def fingerprint(values: np.ndarray) -> str:
    """The first 16 hex digits of the SHA-256 of the values as float64."""
    return hashlib.sha256(np.ascontiguousarray(values, "<f8").tobytes()).hexdigest()[:16]
