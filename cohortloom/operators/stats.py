"""Correlations, trend lines and paired tests from sums over one scan."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null, stars
from cohortloom.functions.tails import t_two_sided
from cohortloom.operators.aggregates import with_group
from cohortloom.operators.columns import feature_vector, name_array


def pearson_with_target(df: DataFrame, names: Sequence[str], target: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, feature, n, r, p) of every column against the target."""
    values = F.transform(feature_vector(names, clip=False), nan_to_null)
    labels = name_array(names)
    y = nan_to_null(named(target).cast("double"))
    pairs = (
        df.select(*[named(g) for g in group], y.alias("_y"), F.posexplode(values).alias("pos", "_x"))
        .filter("_x is not null and _y is not null")
        .groupBy(*[named(g) for g in group], "pos")
        .agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"))
    )
    dof = F.col("n") - 2
    t = F.when(
        dof > 0,
        F.when(F.abs("r") >= 1.0, F.lit(float("inf"))).otherwise(
            F.col("r") * F.sqrt(dof / (F.lit(1.0) - F.col("r") * F.col("r")))
        ),
    )
    return pairs.select(*[named(g) for g in group], F.get(labels, F.col("pos")).alias("feature"), "n", "r", t.alias("_t")).withColumn(
        "p", t_two_sided(F.col("_t"), F.col("n") - 2)
    ).drop("_t")


def trend_line(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept per group."""
    xv, yv = nan_to_null(named(x).cast("double")), nan_to_null(named(y).cast("double"))
    return df.groupBy(*[named(g) for g in group]).agg(
        F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept")
    )


def trend_lines(df: DataFrame, names: Sequence[str], y: str) -> DataFrame:
    """(feature, slope, intercept) of every column against ``y``, in one scan."""
    values = F.transform(feature_vector(names, clip=False), nan_to_null)
    return (
        df.select(nan_to_null(named(y).cast("double")).alias("_y"), F.posexplode(values).alias("pos", "_x"))
        .groupBy("pos")
        .agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
        .select(F.get(name_array(names), F.col("pos")).alias("feature"), "slope", "intercept")
    )


def paired_tests(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """(group, first, second, n, mean_diff, t, p) for all column pairs.

    One aggregate per column pair over a single scan; groups with one row
    are left out.
    """
    _, kept = with_group(df, group)
    pairs = list(combinations(names, 2))
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        d = nan_to_null(named(a).cast("double")) - nan_to_null(named(b).cast("double"))
        aggregates += [F.count(d).alias(f"_n{i}"), F.avg(d).alias(f"_m{i}"), F.stddev_samp(d).alias(f"_s{i}")]
    sums = kept.groupBy(named(group)).agg(F.count("*").alias("_rows"), *aggregates).filter("_rows > 1")
    entries = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("first"),
                    F.lit(b).alias("second"),
                    F.col(f"_n{i}").alias("n"),
                    F.col(f"_m{i}").alias("mean_diff"),
                    F.col(f"_s{i}").alias("sd"),
                )
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
    rows = sums.select(named(group), entries.alias("e")).select(named(group), "e.*")
    t = F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt(F.col("n")))
    return rows.withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1)).drop("sd")


def adjust_bh(tests: DataFrame, group: Sequence[str], ids: Sequence[str], p: str = "p", out: str = "p_adjusted"):
    """False-discovery adjustment inside each group of tests.

    The windows run over tests (column pairs), not over subjects.
    """
    keys = [named(g) for g in group]
    present = tests.filter(named(p).isNotNull())
    ranked = W.partitionBy(*keys).orderBy(named(p), *[named(i) for i in ids])
    falling = W.partitionBy(*keys).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return (
        present.withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_raw", named(p) * F.count("*").over(W.partitionBy(*keys)) / F.col("_rank"))
        .withColumn(out, F.least(F.min("_raw").over(falling), F.lit(1.0)))
        .drop("_rank", "_raw")
    )


def significant_only(tests: DataFrame, p: str = "p_adjusted") -> DataFrame:
    """Tests that reach a star, with their star code."""
    return tests.withColumn("code", stars(named(p))).filter(F.col("code").isNotNull())
