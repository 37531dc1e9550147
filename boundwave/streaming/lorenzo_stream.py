"""Quantization of unbounded series: difference predictors with three lattice points of state for each series.

Samples of one series must come in order; one that comes late is rejected and counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tolerance import tau_sql, with_tau
from ..operators.lorenzo import WEIGHTS
from ..sources import series as views

OUT = "sid string, t long, q long, late long"
STATE = "t long, m1 long, m2 long, m3 long, late long"


def encode_stream(samples: DataFrame, order: int = 2) -> DataFrame:
    """(sid, t, q, late) of a stream (sid, t, x, tau); late counts the series' rejected samples so far."""
    weights = WEIGHTS[order]

    def step(key, frames, state: GroupState):
        last, *held, late = state.get if state.exists else (-1, 0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        t = rows["t"].to_numpy()
        new = t > np.concatenate(([last], np.maximum(t[:-1], last)))  # neither late nor a repetition
        m = np.rint(rows["x"].to_numpy() / (2 * rows["tau"].to_numpy())).astype(np.int64)[new]
        past = np.concatenate((held[::-1], m)).astype(np.int64)
        q = m - sum(c * past[2 - j : len(past) - 1 - j] for j, c in enumerate(weights))
        rejected = late + np.cumsum(~new)
        state.update((int(max(last, t[-1])), *past[: -4 : -1].tolist(), int(rejected[-1])))
        yield pd.DataFrame({"sid": key[0], "t": t[new], "q": q, "late": rejected[new]})

    return samples.groupBy("sid").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame) -> tuple[DataFrame, int]:
    """(all rows that a bounded stream yields, batches it took), through files in the shared folder."""
    from ..plans.storage import scratch

    spark, out = stream.sparkSession, scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in q.recentProgress)
    return spark.read.schema(stream.schema).parquet(out), batches


def stream_lorenzo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second differences of the revenue series, coded as they stream: three files, a batch for each."""
    from ..plans.storage import scratch

    path = scratch(spark)
    rows = with_tau(views.daily_revenue(spark, sf_dir), (0.05,)).select("sid", "t", "x", "tau").persist()
    ends = [int(v) for v in rows.agg(F.percentile("t", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("p")).first()["p"] or ()]
    for low, high in zip([-1, *ends], [*ends, (1 << 62)], strict=True):  # files are taken in the order in which they were written
        rows.where(F.col("t").between(low + 1, high)).coalesce(1).write.mode("append").parquet(path)
    rows.unpersist()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found, _batches = run_to_end(encode_stream(stream))
    return found.select("sid", "t", "q")


QUERIES = {"stream_lorenzo": stream_lorenzo}
_M = """lattice AS (SELECT s.sid, s.t, cast(round_even(s.x / (2 * p.tau), 0) AS bigint) AS m FROM series s JOIN taus p USING (sid))"""
ORACLE_SQL = {
    "stream_lorenzo": f"WITH {views.REVENUE_SQL}, {tau_sql((0.05,))}, {_M} SELECT sid, t, m - 2 * lag(m, 1, 0) OVER w + lag(m, 2, 0) OVER w AS q FROM lattice WINDOW w AS (PARTITION BY sid ORDER BY t)"
}
