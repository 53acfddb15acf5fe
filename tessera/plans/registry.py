"""Queries by name, each with the SQL that an independent engine can check it against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB equivalent."""

    def put(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def shared_sql(name: str, sql: str) -> None:
    """Register a query whose SQL both engines run; tables stand in braces."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, d, t) for t in tables})

    query(name, sql.format(**{t: t for t in tables}))(run)


def _load() -> None:
    from tessera.plans import graphs, records, relational, similarity, stored, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
