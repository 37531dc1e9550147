"""Arrow grouped maps over whole series, for the loops that are truly sequential."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BIGINT, DOUBLE = pa.int64(), pa.float64()


def by_series(rows: DataFrame, keys: list[str], columns: list[str], work: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Run `work(key values…, sorted columns…)` on each series; it returns columns of one length, keys are added.

    One series is one task's group: series are independent, and a loop over one cannot be split."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("t") if "t" in group.column_names else group
        key = [group.column(k)[0].as_py() for k in keys]
        out = work(*key, *(group.column(c).to_numpy() for c in columns))
        size = len(next(iter(out.values())))
        first = {k: pa.array([v] * size, group.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        return pa.table(first | {k: pa.array(v) for k, v in out.items()})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, {schema}")
