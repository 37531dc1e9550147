"""Command line: compress, decompress, info and bench over files of series.

    python -m boundwave.cli compress OUT FILE.npy… [--rho .05] [--group 16] [--ctx 512] [--min-tau .5] [--predictor last]

OUT is a folder of container files, one for each group of `--group` series (named by number); a series that is
shorter than its group's longest is padded with its last value, and cut again where it is restored. A folder
of NPY files comes out of `decompress`.
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import codec
from .session import session
from .sources import files


def _series(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = [files.npy(spark, p, shortest=False) if p.endswith(".npy") else files.csv_values(spark, p) for p in paths]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("sid", "t", "x")


def grouped(series: DataFrame, size: int) -> DataFrame:
    """(group_id, sid, t, x, length): `size` series to a group in the order of their names, padded to the group's longest."""
    lengths = series.groupBy("sid").agg(F.count(F.lit(1)).alias("length"), F.max_by("x", "t").alias("last"))
    place = F.row_number().over(Window.orderBy("sid")) - 1  # a row for each series
    lengths = lengths.withColumn("group_id", F.format_string("g%05d", F.floor(place / size)))
    wide = lengths.withColumn("wide", F.max("length").over(Window.partitionBy("group_id")))
    pad = wide.where("length < wide").select("group_id", "sid", F.explode(F.sequence("length", F.col("wide") - 1)).alias("t"), F.col("last").alias("x"), "length")
    own = series.join(lengths.select("sid", "group_id", "length"), "sid").select("group_id", "sid", "t", "x", "length")
    return own.unionByName(pad)


def compress(spark: SparkSession, a) -> None:
    began, out = time.perf_counter(), Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    series = grouped(_series(spark, a.files), a.group).persist()
    names = series.groupBy("group_id", "sid").agg(F.first("length").alias("length")).collect()  # a row for each series
    values, size, worst = 0, 0, 0.0
    for r in codec.compress(series, a.rho, a.min_tau, a.predictor, a.ctx).toLocalIterator():  # one container at a time
        (out / f"{r['group_id']}.bin").write_bytes(bytes(r["blob"]))
        lengths = {n["sid"]: n["length"] for n in names if n["group_id"] == r["group_id"]}
        (out / f"{r['group_id']}.json").write_text(json.dumps({"sids": list(r["sids"]), "lengths": [lengths[s] for s in r["sids"]]}))
        values, size, worst = values + sum(lengths.values()), size + len(r["blob"]), max(worst, r["worst"])
    series.unpersist()
    print(f"{len(names)} series, {values} values: {size} bytes, {8 * size / max(1, values):.3f} bits a value, worst error {worst:.3f} of its bound, {values / (time.perf_counter() - began):.0f} values/s")


def decompress(spark: SparkSession, a) -> None:
    out, digest = Path(a.out), {}
    out.mkdir(parents=True, exist_ok=True)
    found = codec.decompress(files.containers(spark, f"{a.blobs}/*.bin"), a.predictor)
    for (group,) in found.select("group_id").distinct().orderBy("group_id").collect():
        held = json.loads((Path(a.blobs) / f"{group}.json").read_text())
        rows = found.where(F.col("group_id") == group).orderBy("sid", "t").toArrow()  # one group at a time
        sid, x = np.array(rows.column("sid").to_pylist()), rows.column("xhat").to_numpy()
        for k, (name, n) in enumerate(zip(held["sids"], held["lengths"], strict=True)):
            values = x[sid == str(k)][:n]
            target = out / f"{name}.npy"
            target.parent.mkdir(parents=True, exist_ok=True)
            np.save(target, values)
            digest[name] = codec.fingerprint(values)
    print(f"wrote {len(digest)} series to {a.out}" + "".join(f"\n{k} sha256 {v}" for k, v in sorted(digest.items()) if a.digest))


def info(spark: SparkSession, a) -> None:
    codec.info(files.containers(spark, f"{a.blobs}/*.bin")).orderBy("group_id", "part", "g").show(1000, truncate=False)


def bench(spark: SparkSession, a) -> None:
    """Coded bits a value of all six classical quantizers and of the chosen forecaster, and values a second of each."""
    from .functions.tolerance import with_tau
    from .operators import predictors, rangecoder
    from .operators.grouped import by_series

    def work(_sid, _rho, x, tau):
        every = dict(predictors.CLASSICAL) | {a.predictor: lambda x, tau: predictors.closed_loop(x, tau, predictors.REGISTRY[a.predictor](), a.ctx)}
        out = []
        for f in every.values():
            began = time.perf_counter()
            q = f(x, float(tau[0]))[0]
            out.append((8 * len(rangecoder.encode(q)) / max(1, len(x)), len(x) / max(1e-9, time.perf_counter() - began)))
        bpv, speed = (np.array(v) for v in zip(*out, strict=True))
        return {"predictor": np.array(list(every)), "n": np.full(len(out), len(x)), "bpv": bpv, "values_per_s": speed}

    found = by_series(with_tau(_series(spark, a.files), (a.rho,), a.min_tau), ["sid", "rho"], ["x", "tau"], work, "predictor string, n long, bpv double, values_per_s double")
    found.orderBy("sid", "bpv").show(1000, truncate=False)


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    sub = top.add_subparsers(required=True)
    for name, f in (("compress", compress), ("decompress", decompress), ("info", info), ("bench", bench)):
        p = sub.add_parser(name)
        p.set_defaults(fn=f)
        p.add_argument("--rho", type=float, default=0.05)
        p.add_argument("--ctx", type=int, default=512)
        p.add_argument("--group", type=int, default=16)
        p.add_argument("--min-tau", type=float, default=0.5)
        p.add_argument("--predictor", default="last")
        p.add_argument("--digest", action="store_true")
        if name in ("info", "decompress"):
            p.add_argument("blobs")
        if name in ("compress", "decompress"):
            p.add_argument("out")
        if name in ("compress", "bench"):
            p.add_argument("files", nargs="+")
    a = top.parse_args(args)
    a.fn(session(), a)


if __name__ == "__main__":
    main()
