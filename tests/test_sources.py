"""File scans, sinks, cleaning and the codec on DataFrames."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundwave.functions import cleaning, codelength
from boundwave.operators import codec
from boundwave.sources import files, synthetic


def values(df):
    out = {}
    for r in df.orderBy("sid", "t").collect():
        out.setdefault(r["sid"], []).append(r["x"])
    return out


def test_npy_and_csv(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([1.5, 2.5, 3.0]))
    np.save(tmp_path / "b.npy", np.array([7, 8]))
    assert values(files.npy(spark, str(tmp_path / "*.npy"))) == {"a": [2.0, 2.0], "b": [7.0, 8.0]}
    assert len(values(files.npy(spark, str(tmp_path / "*.npy"), shortest=False))["a"]) == 3
    (tmp_path / "c.csv").write_text("1,2\n3,4.5\n")
    assert values(files.csv_values(spark, str(tmp_path / "c.csv"))) == {"c": [1.0, 2.0, 3.0, 4.0]}


def test_npz_raw_and_results(spark, tmp_path):
    np.savez(tmp_path / "c.npz", **{"q|s|0.05": np.array([1.0, -2.0]), "u|s|0.05": np.zeros((2, 3))})
    rows = files.npz(spark, str(tmp_path / "c.npz")).where("kind = 'q'").orderBy("t").collect()
    assert [(r["sid"], r["rho"], r["x"]) for r in rows] == [("s", 0.05, 1.0), ("s", 0.05, -2.0)]
    np.arange(24, dtype="<f4").tofile(tmp_path / "v.bin")
    start, n = files.plane_rows(3, 4, 1, 2)
    assert values(files.raw_float32(spark, str(tmp_path / "v.bin"), start, n)) == {"v": [12.0, 13, 14, 15, 16, 17]}
    (tmp_path / "r.json").write_text(json.dumps({"a|0.05": {"gain": 1.5}, "b|0.2": {"gain": 2.0}}))
    got = files.results(spark, str(tmp_path / "r.json"), ["name", "rho"]).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", "0.05", "gain", 1.5), ("b", "0.2", "gain", 2.0)]


def test_grid_transit_pageviews_timestamped(spark, tmp_path):
    head = "Balancing Authority,Demand (MW),Demand (MW) (Imputed)\n"
    lines = [f'A,"1,0{i:02d}",' if i % 10 else "A,,1005" if i % 20 else "A,NA," for i in range(100)]
    (tmp_path / "g.csv").write_text(head + "\n".join(lines + ["B,5,"] * 100) + "\n")
    got = values(files.grid_load(spark, str(tmp_path / "g.csv"), least=50, missing=0.2))
    assert list(got) == ["A"] and got["A"][0] == 1001.0 and got["A"][10] == 1005.0 and got["A"][20] == 1020.0
    (tmp_path / "t.json").write_text(json.dumps([{"transit_timestamp": "h1", "station_complex_id": "1", "r": "2"}, {"transit_timestamp": "h1", "station_complex_id": "1", "r": "3"}, {"transit_timestamp": "h2", "station_complex_id": "2", "r": "4"}]))
    assert values(files.transit(spark, str(tmp_path / "t.json"))) == {"1": [5.0, 0.0], "2": [0.0, 4.0]}
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"views": 3}, {"views": 5}]}))
    assert values(files.pageviews(spark, str(tmp_path / "p.json"))) == {"p": [3.0, 5.0]}
    (tmp_path / "n.csv").write_text("timestamp,value\n2020-01-01,0.5\n2020-01-02,2.25\n")
    assert values(files.timestamped(spark, str(tmp_path / "n.csv"))) == {"n": [5000.0, 22500.0]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", i, float(i), 0.05) for i in range(4)], "sid string, t long, x double, rho double")
    files.write_npy(df, str(tmp_path / "npy"))
    r = spark.read.parquet(str(tmp_path / "npy")).first()
    assert np.load(io.BytesIO(r["npy"])).tolist() == [0, 1, 2, 3]
    files.write_cache(df, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).where("rho = 0.05").count() == 4
    files.write_results(df, str(tmp_path / "res"))
    files.write_markdown(df.select("sid", "t"), str(tmp_path / "md"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert text[0] == "| sid | t |" and "| s | 3 |" in text


def test_gap_fill_clamps(spark):
    rows = [("s", i, x) for i, x in enumerate([None, float("nan"), 2.0, None, None, 5.0, None])] + [("none", 0, None)]
    got = values(cleaning.gap_fill(spark.createDataFrame(rows, "sid string, t long, x double")))
    assert got == {"s": [2.0, 2.0, 2.0, 3.0, 4.0, 5.0, 5.0], "none": [None]}


def test_running_mean_over_blocks(spark):
    r = np.random.default_rng(0)
    v = np.abs(r.normal(0, 3, 700))
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "sid string, t long, v double")
    got = [row["m"] for row in codelength.running_mean(df, "v", 4, "m").orderBy("t").collect()]
    acc, want = max(v[:4].mean(), 1e-3), []
    for x in v:
        want.append(max(acc, 1e-3))
        acc += (x - acc) / 4
    assert np.allclose(got, want)


def test_quantile_cdf(spark):
    q = [float(i) for i in range(1, 10)]
    df = spark.createDataFrame([(q, x) for x in (0.0, 1.0, 4.5, 9.0, 20.0)], "q array<double>, x double")
    got = [r[0] for r in df.select(codelength.quantile_cdf(F.col("q"), F.col("x"))).collect()]
    assert got == pytest.approx([0.1 * np.exp(-1), 0.1, 0.45, 0.9, 1 - 0.1 * np.exp(-11)])
    mass = df.select(codelength.t3_cdf(F.col("x"))).collect()
    assert mass[0][0] == pytest.approx(0.5)


def test_codec_frames(spark):
    s = synthetic.corpus(spark, 300, names=("ar1", "iid_noise")).withColumn("group_id", F.lit("g"))
    blobs = codec.compress(s, 0.05, context=64).cache()
    assert blobs.first()["worst"] <= 1 + 1e-9
    assert codec.decompress(blobs).count() == 600
    assert codec.info(blobs).count() == 4
    assert {r["sid"] for r in synthetic.meta(s).collect()} == {"ar1", "iid_noise"}


def test_partitioning_changes_nothing(spark):
    s = synthetic.corpus(spark, 200, names=("ar1", "random_walk")).withColumn("group_id", F.col("sid"))
    a = {r["group_id"]: bytes(r["blob"]) for r in codec.compress(s, 0.05, context=32).collect()}
    b = {r["group_id"]: bytes(r["blob"]) for r in codec.compress(s.repartition(7).orderBy(F.rand(1)), 0.05, context=32).collect()}
    assert a == b


def test_group_size_and_padding_change_nothing(spark):
    from boundwave.operators import container, predictors

    r = np.random.default_rng(0)
    parts = [np.rint(np.cumsum(r.normal(0, 30, 400))) for _ in range(5)]
    taus = [2.0, 3.0, 4.0, 5.0, 6.0]
    _, alone = zip(*(container.encode([x], [tau], predictors.Last(), 64) for x, tau in zip(parts, taus, strict=True)), strict=True)
    _, together = container.encode(parts, taus, predictors.Last(), 64)
    _, turned = container.encode(parts[::-1], taus[::-1], predictors.Last(), 64)
    padded = [container.encode([np.concatenate((x, x[-1:]))], [tau], predictors.Last(), 64)[1][0][:-1] for x, tau in zip(parts, taus, strict=True)]
    for i in range(5):
        assert (alone[i][0] == together[i]).all() and (turned[4 - i] == together[i]).all() and (padded[i] == together[i]).all()


def stream_of(spark, path, batches):
    schema = "sid string, t long, x double, tau double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_rejects_late(spark, tmp_path):
    from boundwave.streaming.lorenzo_stream import encode_stream, run_to_end

    stream = stream_of(spark, str(tmp_path / "in"), [[("s", t, float(10 * t), 1.0) for t in (0, 1, 2, 2)]])
    got, _ = run_to_end(encode_stream(stream, 1))
    assert [(r["t"], r["q"], r["late"]) for r in got.orderBy("t").collect()] == [(0, 0, 0), (1, 5, 0), (2, 5, 0)]


def test_stream_carries_state_over_batches(spark, tmp_path):
    from boundwave.operators.lorenzo import closed_loop
    from boundwave.streaming.lorenzo_stream import encode_stream, run_to_end

    x = np.rint(np.cumsum(np.random.default_rng(2).normal(0, 40, 60)))
    rows = [("s", t, float(v), 1.3) for t, v in enumerate(x)]
    for order in (1, 2, 3):
        stream = stream_of(spark, str(tmp_path / f"in{order}"), [rows[:1], rows[1:3], rows[3:40], [rows[5], *rows[40:]]])
        got, batches = run_to_end(encode_stream(stream, order))
        got = got.orderBy("t").collect()
        assert batches == 4 and [r["q"] for r in got] == closed_loop(x, 1.3, order)[0].tolist()
        assert got[-1]["late"] == 1 and got[39]["late"] == 0


def test_stream_query_takes_several_batches(spark):
    from boundwave.streaming import lorenzo_stream

    seen = []
    original = lorenzo_stream.run_to_end
    try:
        lorenzo_stream.run_to_end = lambda s: seen.append(original(s)) or seen[-1]
        lorenzo_stream.stream_lorenzo(spark, "/root/testdata/sf0.001")
    finally:
        lorenzo_stream.run_to_end = original
    assert seen[0][1] == 3


def test_long_series_are_filled_in_time(spark):
    from time import perf_counter

    s = spark.range(1_000_000).select(F.lit("s").alias("sid"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("x"))
    began = perf_counter()
    r = cleaning.gap_fill(s).agg(F.sum(F.abs(F.col("x") - F.least(F.col("t"), F.lit(999000)))).alias("e"), F.count("x").alias("n")).first()
    assert r["n"] == 1_000_000 and r["e"] < 1e-3 and perf_counter() - began < 60


def test_bounds_of_small_series_keep_their_digits(spark):
    from boundwave.functions.tolerance import tolerances

    r = np.random.default_rng(4)
    x = r.normal(0, 1e-6, 500)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "sid string, t long, x double")
    got = {row["rho"]: row["tau"] for row in tolerances(df, floor=1e-12).collect()}
    for rho, tau in got.items():
        assert tau == pytest.approx(rho * x.std(), rel=1e-8)


def test_command_line_round_trip(spark, tmp_path, capsys, monkeypatch):
    from boundwave import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    r = np.random.default_rng(8)
    x = {f"s{i}": np.rint(np.cumsum(r.normal(0, 20, n))) for i, n in enumerate((300, 280, 300))}
    for k, v in x.items():
        np.save(tmp_path / f"{k}.npy", v)
    names = [str(tmp_path / f"{k}.npy") for k in x]
    cli.main(["compress", str(tmp_path / "out"), *names, "--group", "2", "--ctx", "64"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["g00000.bin", "g00000.json", "g00001.bin", "g00001.json"]
    assert "3 series, 880 values" in capsys.readouterr().out
    cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "back"), "--digest"])
    assert capsys.readouterr().out.count("sha256") == 3
    for k, v in x.items():
        padded = np.concatenate((v, np.repeat(v[-1:], 300 - len(v)))) if k == "s1" else v
        back = np.load(tmp_path / "back" / f"{k}.npy")
        assert len(back) == len(v) and np.abs(back - v).max() <= max(0.05 * padded.std(), 0.5) + 1e-6
    cli.main(["info", str(tmp_path / "out")])
    assert capsys.readouterr().out.count("body") == 3
    cli.main(["bench", names[0]])
    shown = capsys.readouterr().out
    assert all(p in shown for p in ("lpc32", "interp_cubic", "lorenzo3", "last"))


def test_containers_without_names(spark, tmp_path):
    from boundwave.operators import container, predictors

    x = np.rint(np.cumsum(np.random.default_rng(1).normal(0, 9, 100)))
    blob, (want,) = container.encode([x], [2.0], predictors.Last(), 32)
    (tmp_path / "a.bin").write_bytes(blob)
    got = codec.decompress(files.containers(spark, f"{tmp_path}/*.bin")).orderBy("t").collect()
    assert [r["xhat"] for r in got] == pytest.approx(want.tolist()) and {(r["group_id"], r["sid"]) for r in got} == {("a", "0")}
