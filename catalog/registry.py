"""Name -> (Spark query, optional SQL for the same result)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

from cohortloom.functions.rowwise import double_of, quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so two engines' last bits do not matter."""
    floating = (DoubleType, FloatType)
    return df.selectExpr(
        *[
            f"round({double_of(f.name)}, {digits}) + 0D AS {quoted(f.name)}"
            if isinstance(f.dataType, floating)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"
