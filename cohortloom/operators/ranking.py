"""Top-n, sampling, folds, ordered rows and their positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null, order_index, probability_of
from cohortloom.operators.spread import hash_cut, hash_rank, sorted_position
from cohortloom.runtime import bounded_rows


def top_per_group(patterns: DataFrame, group: str, score: str, place: str, n: int) -> DataFrame:
    """The ``n`` highest scores per group; ties go to the lower place."""
    window = W.partitionBy(named(group)).orderBy(nan_to_null(named(score).cast("double")).desc_nulls_last(), named(place))
    return patterns.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def ranked_long(df: DataFrame, keep: Sequence[str], names: Sequence[str], labels: Mapping[str, str] | None = None):
    """All columns of a row ranked by value: (keep, Rank, Topic, Weight).

    Sorted inside the row, so nothing is shuffled. Ties go to the column
    listed first.
    """
    entries = F.array(
        *[
            F.struct((-named(n).cast("double")).alias("w"), F.lit(i).alias("i"), F.lit((labels or {}).get(n, n)).alias("t"))
            for i, n in enumerate(names)
        ]
    )
    return df.select(*[named(k) for k in keep], F.posexplode(F.array_sort(entries)).alias("_p", "_e")).select(
        *[named(k) for k in keep],
        (F.col("_p") + 1).alias("Rank"),
        F.col("_e.t").alias("Topic"),
        (-F.col("_e.w")).alias("Weight"),
    )


def cap_per_class(
    df: DataFrame, label: str, ids: Sequence[str], cap: int, special: Mapping[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """At most ``cap`` seeded-random rows per class; special classes differ.

    Classes at or below their cap stay whole; rows without a class drop.
    """
    limit = F.lit(int(cap))
    for name, n in (special or {}).items():
        limit = F.when(named(label) == name, F.lit(int(n))).otherwise(limit)
    return hash_cut(df, label, ids, limit, seed)


def sample_rows(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of ``min(n, rows)`` rows."""
    return hash_cut(df.withColumn("_all", F.lit(1)), "_all", ids, F.lit(int(n)), seed).drop("_all")


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes per class differ by at most one."""
    return (
        hash_rank(df, label, ids, seed)
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
        .drop("_rank", "_size")
    )


def stratified_holdout(df: DataFrame, label: str, ids: Sequence[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add boolean ``is_test`` for a fixed share of every class."""
    return (
        hash_rank(df, label, ids, seed)
        .withColumn("is_test", F.col("_rank") <= F.round(F.col("_size") * F.lit(float(share))))
        .drop("_rank", "_size")
    )


def group_then_score(df: DataFrame, group: str, order: Sequence[str], score: str, ids: Sequence[str]) -> list[Column]:
    """Sort keys: listed group order, score descending, then id.

    Values outside the list count as a missing group and come last.
    """
    return [order_index(named(group), order).asc_nulls_last(), nan_to_null(named(score).cast("double")).desc_nulls_last(), *[named(i) for i in ids]]


def order_by_groups(df: DataFrame, group: str, order: Sequence[str], score: str, ids: Sequence[str]) -> DataFrame:
    """Rows with their ``position`` in group order and falling score."""
    return sorted_position(df, group_then_score(df, group, order, score, ids))


def order_by_true_probability(
    df: DataFrame, label: str, classes: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    """Rows placed by class, then by the probability of their own class.

    Rows whose class is not listed are left out.
    """
    known = df.filter(named(label).isin(*classes)).withColumn("p_true", probability_of(named(label), classes))
    return order_by_groups(known, label, classes, "p_true", ids)


def order_by_dominant(df: DataFrame, label: str, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Rows placed by class, then by the index of their largest topic."""
    values = F.array(*[nan_to_null(named(n).cast("double")) for n in names])
    dominant = (F.array_position(values, F.array_max(values)) - 1).cast("int")
    df = df.withColumn("dominant", dominant)
    return sorted_position(df, [named(label).asc_nulls_last(), F.col("dominant"), *[named(i) for i in ids]])


def group_boundaries(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Start, end and centre of each group's block in the listed order."""
    listed = df.filter(named(group).isin(*order))
    counts = listed.groupBy(named(group)).agg(F.count("*").alias("n"))
    counts = counts.withColumn("order_idx", order_index(named(group), order))
    # one row per listed group
    running = W.orderBy("order_idx").rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.withColumn("end", F.sum("n").over(running))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("center", F.col("start") + F.col("n") / 2.0)
    )


def best_setting(results: DataFrame, setting: str, score: str, smallest: bool = True) -> DataFrame:
    """The setting with the smallest (or largest) score; missing scores don't count."""
    pick = F.min_by if smallest else F.max_by
    edge = F.min if smallest else F.max
    value = nan_to_null(named(score).cast("double"))
    return results.agg(pick(named(setting), value).alias(setting), edge(value).alias(score))


def mismatch_positions(placed: DataFrame, observed: str, predicted: str, position: str = "position") -> DataFrame:
    """Places of the rows whose prediction differs from the observation."""
    return placed.filter(~named(observed).eqNullSafe(named(predicted))).select(
        named(position), named(observed), named(predicted)
    )


def last_split(regions: DataFrame, place: str, keep: int = 62) -> DataFrame:
    """The last ``keep`` regions with ``hemi``: first half L, second half R."""
    total = regions.agg(F.max(named(place)) + 1).first()[0] or 0
    if total < keep:
        raise ValueError(f"{total} regions, at least {keep} needed")
    first = total - keep
    return (
        regions.filter(named(place) >= first)
        .withColumn("slot", (named(place) - first).cast("int"))
        .withColumn("hemi", F.when(F.col("slot") < keep // 2, "L").otherwise("R"))
    )


def class_list(df: DataFrame, label: str, limit: int = 10_000) -> list[str]:
    """Sorted class names; a model's classes, so bounded."""
    rows = df.filter(named(label).isNotNull()).select(named(label).cast("string").alias("c")).distinct()
    return sorted(r["c"] for r in bounded_rows(rows, limit, f"classes in {label}"))
