"""Column selection, renames and column-family helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import double_of, lower_bound_zero, named, quoted
from cohortloom.operators.spread import sorted_position


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, by position."""
    names = df.columns
    for n in (first, last):
        if n not in names:
            raise ValueError(f"no column {n!r}")
    i, j = names.index(first), names.index(last)
    if i > j:
        raise ValueError(f"{first!r} comes after {last!r}")
    return names[i : j + 1]


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[named(n) for n in names])


def rename_by(df: DataFrame, rule: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    """Rename by dictionary or by a function of the name."""
    new = (lambda c: rule.get(c, c)) if isinstance(rule, Mapping) else rule
    return df.selectExpr(*[f"{quoted(c)} AS {quoted(new(c))}" for c in df.columns])


def suffix_family(df: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Append ``suffix`` to every name with the prefix ('' means all)."""
    return rename_by(df, lambda c: c + suffix if c.startswith(prefix) else c)


def swap_family(names: Sequence[str], old: str, new: str) -> list[str]:
    return [n.replace(old, new) for n in names]


def add_family(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Add many columns in one projection."""
    kept = [named(c) for c in df.columns if c not in values]
    return df.select(*kept, *[v.alias(n) for n, v in values.items()])


def side_by_side(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Put two frames of the same rows next to each other, matched by id."""
    return left.join(right, list(on), "left")


def text_key(column: Column) -> Column:
    """Key as text; whole floating values lose their ``.0``."""
    as_double = column.cast("double")
    whole = as_double.isNotNull() & (F.floor(as_double) == as_double) & column.cast("string").endswith(".0")
    return F.when(whole, as_double.cast("long").cast("string")).otherwise(column.cast("string"))


def feature_vector(names: Sequence[str], clip: bool = True) -> Column:
    """The feature block as one array column, negatives clipped at 0."""
    block = F.expr("array(" + ", ".join(double_of(n) for n in names) + ")")
    return F.transform(block, lambda v: lower_bound_zero(v)) if clip else block


def long_features(df: DataFrame, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``pos`` and ``value``, one row per feature."""
    return df.select(
        *[named(k) for k in keep], F.posexplode(feature_vector(names, clip=False)).alias("pos", "value")
    )


def name_array(names: Sequence[str]) -> Column:
    """The feature names as one literal, to turn a place into its name."""
    return F.lit(list(names))


def labels_of(df: DataFrame, label: str, ids: Sequence[str]) -> DataFrame:
    return df.select(*[named(i) for i in ids], named(label).cast("string").alias("label"))


def subject_ids(df: DataFrame, subject: str, order: Sequence[Column] = ()) -> DataFrame:
    """The id column as ``subject_id``; without one, 0-based row numbers.

    Row numbers need a stated total order, as Spark rows have none.
    """
    if subject in df.columns:
        return df.withColumn("subject_id", named(subject).cast("string"))
    if not order:
        raise ValueError(f"no column {subject!r}: give an order for row numbers")
    numbered = sorted_position(df, order, out="_n")
    return numbered.withColumn("subject_id", (F.col("_n") - 1).cast("string")).drop("_n")


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(named(name)).distinct()
