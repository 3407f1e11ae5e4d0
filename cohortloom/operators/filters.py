"""Row filters with pandas-like treatment of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named
from cohortloom.operators.columns import long_features, name_array


def differs_from(df: DataFrame, name: str, value) -> DataFrame:
    """Rows whose value is not ``value``; missing values stay."""
    return df.filter(~named(name).eqNullSafe(F.lit(value)))


def keep_labels(
    df: DataFrame, label: str, include: Sequence | None = None, exclude: Sequence | None = None
) -> DataFrame:
    """Include list wins over exclude list; exclusion keeps missing labels."""
    if include is not None:
        return df.filter(named(label).isin(*include))
    if exclude is not None:
        return df.filter(~F.coalesce(named(label).isin(*exclude), F.lit(False)))
    return df


def exclude_matching(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Drop rows whose text holds the pattern; missing text stays."""
    return df.filter(~F.coalesce(named(name).rlike(pattern), F.lit(False)))


def drop_incomplete(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with null or NaN in the named columns (all by default)."""
    names = list(names) if names is not None else df.columns
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    complete = F.lit(True)
    for n in names:
        complete = complete & named(n).isNotNull()
        if n in floating:
            complete = complete & ~F.isnan(named(n))
    return df.filter(complete)


def missing_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per feature with the number of null or NaN values."""
    labels = name_array(names)
    return (
        long_features(df, [], names)
        .groupBy("pos")
        .agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"))
        .select(F.get(labels, F.col("pos")).alias("feature"), "n_missing")
    )


def require_complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise if any feature value is missing, naming the columns."""
    bad = [r["feature"] for r in missing_counts(df, names).filter("n_missing > 0").collect()]
    if bad:
        raise ValueError(f"missing values in {sorted(bad)}")
    return df


def split_reference(df: DataFrame, label: str, reference) -> tuple[DataFrame, DataFrame]:
    """(reference rows, all other rows); missing labels go to the others."""
    is_reference = named(label).eqNullSafe(F.lit(reference))
    return df.filter(is_reference), df.filter(~is_reference)


def compare_columns(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def flag_set(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(named(flag) == 1)


def groups_of_size(df: DataFrame, group: str, minimum: int) -> DataFrame:
    """Rows of groups with at least ``minimum`` rows."""
    big = df.groupBy(named(group)).count().filter(F.col("count") >= minimum).select(named(group))
    return df.join(big, [group], "left_semi")


def confusion_cell(df: DataFrame, observed: str, predicted: str, observed_is, predicted_is) -> DataFrame:
    return df.filter((named(observed) == observed_is) & (named(predicted) == predicted_is))


def first_match(
    df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, order: Sequence[Column]
) -> DataFrame:
    """Add the ``value`` of the first lookup row with the same key."""
    first = (
        lookup.withColumn("_rn", F.row_number().over(W.partitionBy(named(lookup_key)).orderBy(*order)))
        .filter("_rn = 1")
        .select(named(lookup_key).alias("_k"), named(value).alias(value))
    )
    return df.join(first, named(key) == F.col("_k"), "left").drop("_k")
