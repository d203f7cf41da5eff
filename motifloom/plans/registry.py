"""The registry that queries enter themselves into, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _sql[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def in_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))
