"""The registry of queries: key -> (function of the fixtures, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):  # noqa: ANN201
    """Registers a function from Fixtures to a DataFrame under ``key``."""

    def register(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = oracle(sql)
        return f

    return register
