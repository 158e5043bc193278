"""Every query of the library by name, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest-route matrix of the synthetic street network."""
    return QUERIES["net188_matrix"](spark, sf_dir)


from . import kernels, more, network, reaching, tables, turning, wide, widest  # noqa: E402, F401  they register their queries
