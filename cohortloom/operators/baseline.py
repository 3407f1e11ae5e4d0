"""Reference-group mean and spread per feature, and the scores against it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import clipped, double_of, lower_bound_zero, named, nan_to_null, number, quoted
from cohortloom.operators.columns import long_features, name_array
from cohortloom.runtime import bounded_rows, join_small

# Added to the population standard deviation (fixed value).
SPREAD_FLOOR = 1e-8
MAX_FEATURES = 100_000
# Numbers that cohort baselines may hold when they are broadcast (32 MB).
BROADCAST_NUMBERS = 4_000_000


def baseline_table(
    reference: DataFrame, names: Sequence[str], by: Sequence[str] = (), null_policy: str = "error"
) -> DataFrame:
    """(by, pos, feature, mean, std) over the reference rows.

    ``null_policy='error'`` makes a feature with a missing reference value
    NaN, as a plain mean over it would be; ``'skip'`` ignores such values.
    """
    long = long_features(reference, by, names)
    labels = name_array(names)
    value = nan_to_null(F.col("value"))
    table = long.groupBy(*[named(b) for b in by], "pos").agg(
        F.avg(value).alias("mean"),
        (F.stddev_pop(value) + F.lit(SPREAD_FLOOR)).alias("std"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("_missing"),
    )
    if null_policy == "error":
        nan = F.lit(float("nan"))
        table = table.withColumns(
            {c: F.when(F.col("_missing") > 0, nan).otherwise(F.col(c)) for c in ("mean", "std")}
        )
    return table.withColumn("feature", F.get(labels, F.col("pos"))).drop("_missing")


@dataclass
class Baseline:
    """Stored mean and spread per feature; a driver-side model of R rows."""

    features: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, reference: DataFrame, names: Sequence[str], null_policy: str = "error") -> "Baseline":
        if not names:
            raise ValueError("no feature columns given")
        rows = bounded_rows(baseline_table(reference, names, (), null_policy), MAX_FEATURES, "baseline")
        if not rows:
            raise ValueError("the reference group has no rows")
        rows.sort(key=lambda r: r["pos"])
        return cls([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])

    def columns(self, clip: bool = True, source: Mapping[str, str] | None = None) -> dict:
        """Score expression per feature: ``max(-(x-m)/s, 0)`` or signed z."""
        return {name: F.expr(text) for name, text in self._texts(clip, source).items()}

    def _texts(self, clip: bool, source: Mapping[str, str] | None) -> dict[str, str]:
        out = {}
        for name, mean, std in zip(self.features, self.means, self.stds):
            x = double_of((source or {}).get(name, name))
            if clip:
                out[name] = clipped(f"(({number(mean)} - {x}) / {number(std)})")
            else:
                out[name] = f"({x} - {number(mean)}) / {number(std)}"
        return out

    def apply(self, df: DataFrame, clip: bool = True, source: Mapping[str, str] | None = None) -> DataFrame:
        """Replace the feature block by scores in one projection."""
        scores = self._texts(clip, source)
        kept = [quoted(c) for c in df.columns if c not in scores]
        return df.selectExpr(*kept, *[f"{text} AS {quoted(n)}" for n, text in scores.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, m, s) for i, (f, m, s) in enumerate(zip(self.features, self.means, self.stds))]
        return spark.createDataFrame(rows, "pos int, feature string, mean double, std double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Baseline":
        rows = sorted(bounded_rows(spark.read.parquet(path), MAX_FEATURES, "baseline"), key=lambda r: r["pos"])
        return cls([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])


@dataclass
class CohortBaselines:
    """One baseline per cohort, each from the cohort's own reference rows."""

    cohort: str
    features: list[str]
    arrays: DataFrame

    @classmethod
    def fit(cls, reference: DataFrame, cohort: str, names: Sequence[str], null_policy: str = "error"):
        table = baseline_table(reference, names, [cohort], null_policy)
        ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
        arrays = table.groupBy(named(cohort)).agg(ordered("mean").alias("_means"), ordered("std").alias("_stds"))
        return cls(cohort, list(names), arrays)

    def apply(self, df: DataFrame, clip: bool = True) -> DataFrame:
        """Score every row against its cohort; without reference rows of its cohort a row's scores are missing."""
        cohorts = max(1, BROADCAST_NUMBERS // (2 * len(self.features)))
        joined = join_small(df, self.arrays, [self.cohort], "left", cohorts)
        scores = []
        for i, n in enumerate(self.features):
            z = f"(({double_of(n)} - _means[{i}]) / _stds[{i}])"
            scores.append(f"{clipped('(-' + z + ')') if clip else z} AS {quoted(n)}")
        return joined.selectExpr(*[quoted(c) for c in df.columns if c not in self.features], *scores)


def clip_scores(df: DataFrame, names: Sequence[str], flip: bool = False) -> DataFrame:
    """Clip ready-made scores at 0, after a sign change when asked."""
    sign = "-" if flip else ""
    scores = {n: f"{clipped(sign + double_of(n))} AS {quoted(n)}" for n in names}
    return df.selectExpr(*[scores.get(c, quoted(c)) for c in df.columns])


def score_long(
    df: DataFrame, keep: Sequence[str], names: Sequence[str], table: DataFrame, clip: bool = True
) -> DataFrame:
    """(keep, pos, score) rows, the form group maps are built from.

    The baseline table has one row per feature, so it is broadcast.
    """
    side = F.broadcast(table.select(F.col("pos").alias("_pos"), "mean", "std"))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    score = lower_bound_zero(z, flip=True) if clip else z
    return (
        long_features(df, keep, names)
        .join(side, F.col("pos") == F.col("_pos"))
        .select(*[named(k) for k in keep], "pos", score.alias("score"))
    )


def group_maps(
    df: DataFrame, label: str, names: Sequence[str], table: DataFrame, clip: bool = True, flip: bool = True
) -> DataFrame:
    """(label, pos, feature, score): mean score of each group per feature.

    ``clip`` gives clipped scores; otherwise signed, with ``flip`` the sign
    turned so that loss is positive.
    """
    labels = name_array(names)
    long = score_long(df.filter(named(label).isNotNull()), [label], names, table, clip)
    mean = F.avg("score")
    if not clip and flip:
        mean = -mean
    return long.groupBy(named(label), "pos").agg(mean.alias("score")).withColumn(
        "feature", F.get(labels, F.col("pos"))
    )
