"""All registered queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import analysis_queries, series_queries, workload_queries
from ..streaming import lorenzo_stream

QUERIES: dict = {**series_queries.QUERIES, **analysis_queries.QUERIES, **workload_queries.QUERIES, **lorenzo_stream.QUERIES}
ORACLE_SQL: dict[str, str] = {**series_queries.ORACLE_SQL, **analysis_queries.ORACLE_SQL, **workload_queries.ORACLE_SQL, **lorenzo_stream.ORACLE_SQL}
