"""The tables behind the report figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null, row_total, swap_text
from cohortloom.operators.aggregates import (
    box_summary,
    flag_positive_means,
    group_counts,
    group_means,
    group_means_ordered,
    group_shares,
    with_group,
)
from cohortloom.operators.evaluate import reorder_labels
from cohortloom.operators.ranking import (
    group_boundaries,
    last_split,
    order_by_groups,
    order_by_true_probability,
    top_per_group,
)
from cohortloom.operators.reshape import to_long, to_wide
from cohortloom.operators.stats import pearson_with_target, trend_lines
from cohortloom.operators.spread import sorted_position


def class_profiles(df: DataFrame, group: Sequence[str] | str, names: Sequence[str], y_max: float | None = None):
    """(group, feature, mean, n, y_max) with one scale for all groups.

    The scale is the largest mean times 1.1 unless given.
    """
    groups, kept = with_group(df, group)
    sums = kept.groupBy(*[named(g) for g in groups]).agg(
        F.count("*").alias("n"), *[F.avg(nan_to_null(named(n).cast("double"))).alias(n) for n in names]
    )
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), named(n).alias("mean")) for n in names]))
    long = sums.select(*[named(g) for g in groups], "n", entries.alias("e")).select(
        *[named(g) for g in groups], "n", "e.feature", "e.mean"
    )
    if y_max is not None:
        return long.withColumn("y_max", F.lit(float(y_max)))
    # over group x feature rows
    return long.withColumn("y_max", F.max("mean").over(W.partitionBy()) * F.lit(1.1))


def combination_profiles(
    df: DataFrame, combination: str, count: str, names: Sequence[str], old: str = "FTD_ANY", new: str = "FTD"
) -> DataFrame:
    """Class profiles per (label count, cleaned label combination)."""
    cleaned = df.withColumn(combination, swap_text(named(combination), old, new))
    return class_profiles(cleaned, [count, combination], names)


def group_probability_heatmap(df: DataFrame, group: str, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    return group_means_ordered(df, group, names, order)


def subject_heatmap(
    df: DataFrame, group: str, order: Sequence[str], score: str, names: Sequence[str], ids: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(placed rows, group boundaries) of the subject-wise heatmap."""
    placed = order_by_groups(df, group, order, score, ids)
    keep = [*ids, group, *names, "position"]
    return placed.select(*[named(k) for k in dict.fromkeys(keep)]), group_boundaries(df, group, order)


def group_topic_profiles(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Group means with the largest of them as shared scale."""
    return class_profiles(df, group, names).withColumn("y_max", F.col("y_max") / F.lit(1.1))


def stacked_mixtures(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], topics: Sequence[str], ids: Sequence[str]
) -> DataFrame:
    """(ids, position, topic, bottom, height, misclassified) per bar piece.

    The running stack is inside a row, so only the placing shuffles.
    """
    placed = order_by_true_probability(df, label, classes, ids)
    pieces, below = [], F.lit(0.0)
    for t in topics:
        height = named(t).cast("double")
        pieces.append(F.struct(F.lit(t).alias("topic"), below.alias("bottom"), height.alias("height")))
        below = below + height
    wrong = (~named(label).eqNullSafe(named(predicted))).alias("misclassified")
    return placed.select(
        *[named(i) for i in ids], "position", wrong, F.explode(F.array(*pieces)).alias("e")
    ).select(*[named(i) for i in ids], "position", "misclassified", "e.*")


def ordered_probabilities(
    df: DataFrame, label: str, ids: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Probability columns placed by class and own-class probability.

    The order must be a permutation of the classes that have ``P()``
    columns, and every label must be one of them.
    """
    classes = [c[2:-1] for c in df.columns if c.startswith("P(") and c.endswith(")")]
    order = reorder_labels(classes, order) if order is not None else classes
    unknown = df.filter(named(label).isNull() | ~named(label).isin(*order)).select(named(label)).limit(1).collect()
    if unknown:
        raise ValueError(f"label {unknown[0][0]!r} has no probability column")
    placed = order_by_true_probability(df, label, order, ids)
    return placed.select(*[named(i) for i in ids], named(label), *[named(f"P({c})") for c in order], "position")


def topic_heatmap(patterns: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(full pattern table, top features per topic)."""
    return patterns, top_per_group(patterns, "topic", "weight", "pos", top)


def topic_boxes(df: DataFrame, label: str, topics: Sequence[str]) -> DataFrame:
    """Box summary of every topic weight per class."""
    _, kept = with_group(df, label)
    return box_summary(to_long(kept, [label], topics, "topic", "value"), [label, "topic"], "value")


def discordance_panels(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    names: Sequence[str],
    score: str,
    ids: Sequence[str],
    scatter: str | None = None,
) -> dict[str, DataFrame]:
    """Means, placed subjects, boundaries and, with ``scatter``, correlations."""
    placed, bounds = subject_heatmap(df, group, order, score, names, ids)
    panels = {
        "means": group_probability_heatmap(df, group, order, names),
        "subjects": placed,
        "boundaries": bounds,
        "profiles": group_topic_profiles(df, group, names),
    }
    if scatter is not None:
        panels["correlations"] = pearson_with_target(df, names, scatter)
        panels["lines"] = trend_lines(df, names, scatter)
    return panels


def flag_panels(
    df: DataFrame, flags: Sequence[str], names: Sequence[str], score: str, ids: Sequence[str], minimum: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(profiles of flag-positive rows, rows placed per flag by score)."""
    profiles = flag_positive_means(df, flags, names, minimum)
    raised = F.array_compact(F.array(*[F.when(named(f) == 1, F.lit(f)) for f in flags]))
    rows = df.select(
        *[named(i) for i in ids], *[named(n) for n in dict.fromkeys([*names, score])], F.explode(raised).alias("flag")
    )
    large = group_counts(rows, "flag").filter(F.col("n") >= minimum).select("flag")
    kept = rows.join(F.broadcast(large), ["flag"], "left_semi")  # at most one row per listed flag
    placed = sorted_position(kept, [nan_to_null(named(score).cast("double")).desc_nulls_last(), *[named(i) for i in ids]], ["flag"])
    return profiles, placed


def cell_composition(
    df: DataFrame,
    observed: str,
    predicted: str,
    cells: dict[str, tuple[str, str]],
    label: str,
    labels: Sequence[str],
) -> DataFrame:
    """Label shares inside chosen (observed, predicted) cells, one row each."""
    box = None
    for name, (o, p) in cells.items():
        hit = (named(observed) == o) & (named(predicted) == p)
        box = F.when(hit, F.lit(name)) if box is None else box.when(hit, F.lit(name))
    boxed = df.withColumn("box", box).filter(F.col("box").isNotNull())
    shares = group_shares(boxed, label, ["box"])
    return to_wide(shares, "box", label, "prop", labels, list(cells))


def stage_group_composition(df: DataFrame, group: str, names: Sequence[str], index: Sequence[str]):
    """(mean composition per group, box summary of the summed index)."""
    means = group_means(df, group, names)
    scored = df.withColumn("index_value", row_total(index))
    return means, box_summary(scored, group, "index_value")


def hemisphere_vectors(patterns: DataFrame, group: str, keep: int = 62) -> DataFrame:
    """Patterns split into hemisphere slots with their range per group.

    Runs over pattern rows (topics or classes times features).
    """
    split = last_split(patterns, "pos", keep)
    return split.withColumns(
        {
            "low": F.min("weight").over(W.partitionBy(named(group))),
            "high": F.max("weight").over(W.partitionBy(named(group))),
        }
    )


def importance_bars(importances: DataFrame) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature")
