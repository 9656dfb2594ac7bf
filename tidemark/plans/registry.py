"""All queries of the reference's operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import item_queries, layout_queries, log_queries, parse_queries, record_queries, stream_queries, table_queries, text_queries

MODULES = (log_queries, text_queries, layout_queries, item_queries, parse_queries, table_queries, record_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
