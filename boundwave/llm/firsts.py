"""Later occurrences of 128-bit keys: range partitions, sorted by key and document, are streamed once.

Rows are dealt by ranges of (key, document), so one very common key spreads over many partitions; equal
(key, document) rows meet in one. The first document of a key is the first row of its run. Where a run
began in an earlier partition, the rows of the partition's own first document are later occurrences too:
they are kept apart until the partitions' ends are known (one small row for each partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

LATER, HEAD, ENDS = 0, 1, 2


def later_occurrences(rows: DataFrame, payload: list[str], *then: str) -> DataFrame:
    """doc_id and `payload` of the rows (h1 long, h2 long, doc_id long, ...) whose key a smaller doc_id has too.

    Within a document rows stand in the order of the columns `then`. `rows` should be cheap to read twice (a
    written table), as ranges are drawn from a sample of it first; it is not needed any more afterwards."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in payload)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head = first = last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            run = np.cumsum(new) - 1
            start = doc[new]
            if last is not None and (int(h1[0]), int(h2[0])) == last:
                start[0] = first
            if head is None:
                head = (int(h1[0]), int(h2[0]), int(doc[0]))
            last, first = (int(h1[-1]), int(h2[-1])), int(start[-1])
            later = doc > start[run]
            lead = ~later & (h1 == head[0]) & (h2 == head[1])
            kind = np.where(later, LATER, HEAD).astype(np.int32)
            keep = np.flatnonzero(later | lead)
            if len(keep):
                at, zero = pa.array(keep), pa.array(np.zeros(len(keep), np.int64))
                columns = [pa.array(kind[keep]), pa.array(np.full(len(keep), part, np.int32)), pa.array(doc[keep]), zero, zero, zero, zero]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(3 + i).take(at) for i in range(len(payload)))], names=names)
        if head is not None:
            own = [ENDS, part, 0, head[0], head[1], last[0], last[1]]
            arrays = [pa.array([v], k) for v, k in zip(own, (pa.int32(), pa.int32(), *[pa.int64()] * 5), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(1, k) for k in types)], names=names)

    names = ["kind", "part", "doc_id", "from1", "from2", "to1", "to2", *payload]
    spark = rows.sparkSession
    ranged = rows.select("h1", "h2", "doc_id", *payload).repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", *then)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema[c].dataType) for c in payload]
    schema = f"kind int, part int, doc_id long, from1 long, from2 long, to1 long, to2 long, {kinds}"
    found = written(ranged.mapInArrow(stream, schema))
    ends = sorted(tuple(r) for r in found.where(F.col("kind") == ENDS).select("part", "from1", "from2", "to1", "to2").collect())  # one row for each partition
    carried = [b[0] for a, b in zip(ends, ends[1:], strict=False) if a[3:] == b[1:3]]
    return found.where((F.col("kind") == LATER) | ((F.col("kind") == HEAD) & F.col("part").isin(carried))).select("doc_id", *payload)
