"""Group summaries; all partial aggregation, no whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null, quoted
from cohortloom.operators.columns import feature_vector, long_features, name_array
from cohortloom.operators.spread import exact_quantiles
from cohortloom.runtime import join_small


def with_group(df: DataFrame, group: Sequence[str] | str) -> tuple[list[str], DataFrame]:
    groups = [group] if isinstance(group, str) else list(group)
    for g in groups:
        df = df.filter(named(g).isNotNull())
    return groups, df


def group_means_long(df: DataFrame, group: Sequence[str] | str, names: Sequence[str]) -> DataFrame:
    """(group, pos, feature, mean): one row per group and column."""
    groups, kept = with_group(df, group)
    return (
        long_features(kept, groups, names)
        .groupBy(*[named(g) for g in groups], "pos")
        .agg(F.avg(nan_to_null(F.col("value"))).alias("mean"))
        .withColumn("feature", F.get(name_array(names), F.col("pos")))
    )


def group_means(df: DataFrame, group: Sequence[str] | str, names: Sequence[str]) -> DataFrame:
    """Mean of many columns per group; rows without a group are dropped.

    Means are taken over (position, value) rows: one aggregate per column
    makes generated code too large for wide blocks.
    """
    groups, _ = with_group(df, group)
    long = group_means_long(df, groups, names)
    # at most one entry per feature in each list
    by_pos = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return (
        long.groupBy(*[named(g) for g in groups])
        .agg(by_pos.alias("_m"))
        .selectExpr(*[quoted(g) for g in groups], *[f"_m[{i}].mean AS {quoted(n)}" for i, n in enumerate(names)])
    )


def order_frame(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """A listed category order as rows ``(name, order_idx)``."""
    return df.sparkSession.createDataFrame(
        [(v, i) for i, v in enumerate(order)], f"`{name}` string, order_idx int"
    )


def group_means_ordered(df: DataFrame, group: str, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Group means for exactly the listed groups; absent ones give nulls."""
    means = group_means(df, group, names).withColumn(group, named(group).cast("string"))
    return F.broadcast(order_frame(df, order, group)).join(means, [group], "left").orderBy("order_idx")


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows per group, largest first; missing group dropped."""
    _, kept = with_group(df, group)
    return kept.groupBy(named(group)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), named(group))


def group_shares(df: DataFrame, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Share of every value (missing counts as a value) inside ``within``."""
    counts = df.groupBy(*[named(w) for w in within], named(value)).agg(F.count("*").alias("n"))
    # the window runs over counted values, one row each
    total = F.sum("n").over(W.partitionBy(*[named(w) for w in within]))
    return counts.withColumn("prop", F.col("n") / total)


def flag_prevalence(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    """(group, condition, positive, negative) for 0/1 flags."""
    long = group_means_long(df, group, flags)
    return long.select(
        named(group),
        F.col("feature").alias("condition"),
        F.col("mean").alias("positive"),
        (F.lit(1.0) - F.col("mean")).alias("negative"),
    )


def shared_peak(df: DataFrame, group: Sequence[str] | str, names: Sequence[str]) -> DataFrame:
    """Largest group mean over all groups and columns."""
    return group_means_long(df, group, names).agg(F.max("mean").alias("peak"))


def family_range(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Smallest and largest value over a column family, missing skipped."""
    values = F.transform(feature_vector(names, clip=False), nan_to_null)
    return df.select(F.array_min(values).alias("_lo"), F.array_max(values).alias("_hi")).agg(
        F.min("_lo").alias("low"), F.max("_hi").alias("high")
    )


def flag_positive_means(df: DataFrame, flags: Sequence[str], names: Sequence[str], minimum: int = 1) -> DataFrame:
    """(flag, n, means) over the rows where the flag is set.

    Every row is expanded only into the flags it has set.
    """
    raised = F.array_compact(F.array(*[F.when(named(f) == 1, F.lit(f)) for f in flags]))
    rows = df.select(F.explode(raised).alias("flag"), *[named(n) for n in names])
    return (
        rows.groupBy("flag")
        .agg(F.count("*").alias("n"), *[F.avg(nan_to_null(named(n).cast("double"))).alias(n) for n in names])
        .filter(F.col("n") >= minimum)
    )


def contrast_to_others(means: DataFrame, group: str, target: str, names: Sequence[str]) -> DataFrame:
    """Target's mean minus the plain mean of the other groups' means."""
    values, labels = feature_vector(names, clip=False), name_array(names)
    is_target, mean = named(group).cast("string") == target, nan_to_null(F.col("mean"))
    return (
        means.select(named(group), F.posexplode(values).alias("pos", "mean"))
        .groupBy("pos")
        .agg((F.avg(F.when(is_target, mean)) - F.avg(F.when(~is_target, mean))).alias("contrast"))
        .select(F.get(labels, F.col("pos")).alias("feature"), "contrast")
        .orderBy(F.desc("contrast"), "feature")
    )


def coefficient_importance(coefficients: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute coefficient per feature over all classes, largest first."""
    return (
        long_features(coefficients, [], names)
        .groupBy("pos")
        .agg(F.avg(F.abs(nan_to_null(F.col("value")))).alias("importance"))
        .select(F.get(name_array(names), F.col("pos")).alias("feature"), "importance")
        .orderBy(F.desc("importance"), "feature")
    )


def roi_means(
    voxels: DataFrame, atlas: DataFrame, subject: str, place: Sequence[str], label: str, value: str, background=0
) -> DataFrame:
    """Mean of every labelled area per subject, missing values skipped.

    The label of a place comes from the atlas; background is left out and an
    area without any value has a null mean. ``roi_means_wide`` lays the
    areas out as columns.
    """
    areas = atlas.filter(named(label) != background).select(*[named(p) for p in place], named(label))
    labelled = join_small(voxels, areas, list(place))
    return labelled.groupBy(named(subject), named(label)).agg(
        F.avg(nan_to_null(named(value).cast("double"))).alias("mean")
    )


def roi_means_wide(means: DataFrame, subject: str, label: str, labels: Sequence) -> DataFrame:
    """One column per listed area; an area without rows is null."""
    return means.groupBy(named(subject)).pivot(label, list(labels)).agg(F.first("mean"))


def cell_counts(atlas: DataFrame, label: str) -> DataFrame:
    """Number of cells per label."""
    return atlas.groupBy(named(label)).agg(F.count("*").alias("n_cells"))


def box_summary(df: DataFrame, group: Sequence[str] | str, value: str, reach: float = 1.5) -> DataFrame:
    """Median, quartiles, whiskers and outlier count per group, exactly.

    Whiskers are the outermost values within ``reach`` quartile distances.
    """
    groups, kept = with_group(df, group)
    quartiles = exact_quantiles(kept, groups, value, (0.25, 0.5, 0.75))
    gap = (F.col("q2") - F.col("q0")) * F.lit(float(reach))
    fences = quartiles.withColumn("_lo", F.col("q0") - gap).withColumn("_hi", F.col("q2") + gap)
    rows = kept.select(*[named(g) for g in groups], nan_to_null(named(value).cast("double")).alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return (
        join_small(rows, fences, groups)
        .groupBy(*[named(g) for g in groups], "n", "q0", "q1", "q2")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
        .withColumnsRenamed({"q0": "quartile_1", "q1": "median", "q2": "quartile_3"})
    )


def combination_counts(df: DataFrame, combination: str) -> DataFrame:
    """Rows per label combination, missing left out, largest first."""
    return group_counts(df, combination)


def weights_from_counts(counts: Mapping, columns: Mapping, labels: Sequence) -> list[tuple[str, float]]:
    """(column, cell count) pairs for a label list; repeats count twice."""
    return [(columns[label], float(counts[label])) for label in labels]
