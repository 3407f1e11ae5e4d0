"""Unions and long/wide reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, one_hot
from cohortloom.operators.aggregates import order_frame


def stack_cohorts(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(df: DataFrame, keep: Sequence[str], names: Sequence[str], var: str, value: str) -> DataFrame:
    return df.unpivot([named(k) for k in keep], [named(n) for n in names], var, value)


def to_wide(
    df: DataFrame, index: str, columns: str, values: str, names: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Pivot with absent cells 0 and, on request, a fixed row order."""
    wide = df.groupBy(named(index)).pivot(columns, list(names)).agg(F.first(named(values)))
    wide = wide.na.fill(0.0, list(names))
    if order is None:
        return wide
    rows = order_frame(df, order, index)
    return F.broadcast(rows).join(wide, [index], "left").orderBy("order_idx")


def transpose(df: DataFrame, key: str, names: Sequence[str], rows: Sequence[str], out: str) -> DataFrame:
    """Swap rows and columns of a small table; ``rows`` are its key values."""
    long = to_long(df, [key], names, out, "_value")
    return long.groupBy(named(out)).pivot(key, list(rows)).agg(F.first("_value"))


def with_one_hot(df: DataFrame, name: str, values: Sequence[str], prefix: str) -> DataFrame:
    """0/1 column per listed value; other and missing values give zeros."""
    return df.withColumns(one_hot(named(name), values, prefix))
