"""Algebra on topic weights and topic patterns.

Patterns are model-sized (topics x features): a long table ``(topic, pos,
feature, weight)`` for joins, or a list of rows on the driver for literal
expressions over the subject table, which need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import double_of, named, number
from cohortloom.operators.aggregates import group_means
from cohortloom.operators.ranking import top_per_group
from cohortloom.runtime import bounded_rows, join_small

# Topics and classes become literals of one projection, so they are few.
MAX_TOPICS = 1000


def topic_names(n: int, prefix: str = "Topic_") -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def pattern_frame(spark: SparkSession, matrix: Sequence[Sequence[float]], features: Sequence[str]) -> DataFrame:
    """Long pattern table of a driver-side matrix."""
    rows = [(k, r, features[r], float(w)) for k, row in enumerate(matrix) for r, w in enumerate(row)]
    return spark.createDataFrame(rows, "topic int, pos int, feature string, weight double")


def pattern_wide(patterns: DataFrame, n_topics: int) -> DataFrame:
    """One row per feature with a column per topic."""
    return patterns.groupBy("pos", "feature").agg(
        *[F.max(F.when(F.col("topic") == k, F.col("weight"))).alias(t) for k, t in enumerate(topic_names(n_topics))]
    )


def normalise_patterns(patterns: DataFrame, floor: float = 0.0) -> DataFrame:
    """Weights of each topic divided by their sum (plus ``floor``)."""
    total = F.sum("weight").over(W.partitionBy("topic"))
    return patterns.withColumn("weight", F.col("weight") / (total + F.lit(float(floor))))


def subject_topic_table(df: DataFrame, ids: Sequence[str], label: str, n_topics: int) -> DataFrame:
    return df.select(
        *[named(i) for i in ids], *[named(t) for t in topic_names(n_topics)], named(label).alias("DX")
    )


def weighted_top_scores(
    df: DataFrame, patterns: DataFrame, n: int = 10, score_suffix: str = "_ND", out: str = "{topic}_top10_weighted_z"
) -> DataFrame:
    """Per topic, the weighted sum of its top ``n`` features' scores.

    Feature ``f`` is read from column ``f + score_suffix``; features without
    such a column are left out.
    """
    top = top_per_group(patterns, "topic", "weight", "pos", n).orderBy("topic", "rank")
    rows = bounded_rows(top, MAX_TOPICS * n, "topics")
    have = set(df.columns)
    sums: dict[int, list[str]] = {}
    for r in rows:
        column = r["feature"] + score_suffix
        terms = sums.setdefault(r["topic"], [])
        if column in have:
            terms.append(f"{double_of(column)} * {number(r['weight'])}")
    return df.withColumns(
        {out.format(topic=f"Topic_{k}"): F.expr(" + ".join(v) or "0D") for k, v in sorted(sums.items())}
    )


def class_weights_frame(spark: SparkSession, weights: Mapping[str, Mapping[int, float]], n_topics: int) -> DataFrame:
    """A sparse class x topic weight table made dense (absent is 0)."""
    schema = "DX string, " + ", ".join(f"{t} double" for t in topic_names(n_topics))
    rows = [(dx, *[float(w.get(k, 0.0)) for k in range(n_topics)]) for dx, w in weights.items()]
    return spark.createDataFrame(rows, schema)


def scale_class_means(means: DataFrame, weights: Mapping[str, Mapping[int, float]], n_topics: int) -> DataFrame:
    """Class means times manual weights; unlisted classes become zeros."""
    side = F.broadcast(class_weights_frame(means.sparkSession, weights, n_topics))
    renamed = side.select(F.col("DX").alias("_dx"), *[F.col(t).alias(f"_{t}") for t in topic_names(n_topics)])
    joined = means.join(renamed, means["DX"] == F.col("_dx"), "left")
    return joined.select(
        means["DX"], *[(named(t) * F.coalesce(F.col(f"_{t}"), F.lit(0.0))).alias(t) for t in topic_names(n_topics)]
    )


def project_classes(
    df: DataFrame, weights: DataFrame, label: str, topics: Sequence[str], scores: Sequence[str], prefix: str = "ND_"
) -> DataFrame:
    """``prefix + class``: sum over topics of score times class weight.

    ``weights`` has one row per class; its rows become literals.
    """
    added = {}
    for r in bounded_rows(weights.orderBy(named(label)), MAX_TOPICS, "classes"):
        terms = [f"{double_of(s)} * {number(r[t])}" for t, s in zip(topics, scores)]
        added[f"{prefix}{r[label]}"] = F.expr(" + ".join(terms))
    return df.withColumns(added)


def reconstruct_groups(
    subjects: DataFrame, label: str, patterns: DataFrame, n_topics: int
) -> DataFrame:
    """(label, pos, feature, value): mean topic weights times patterns."""
    topics = topic_names(n_topics)
    means = group_means(subjects, label, topics).select(
        named(label), F.posexplode(F.array(*[named(t) for t in topics])).alias("topic", "mean")
    )
    return (
        join_small(means, patterns, ["topic"])
        .groupBy(named(label), "pos", "feature")
        .agg(F.sum(F.col("mean") * F.col("weight")).alias("value"))
    )


def mixture(matrix: Sequence[Sequence[float]], topics: Sequence[int], weights: Sequence[str], pos: int) -> str:
    """SQL text of ``sum_k w_k * H[k, pos]`` over the chosen topics."""
    return "(" + (" + ".join(f"{double_of(weights[k])} * {number(matrix[k][pos])}" for k in topics) or "0D") + ")"


def partial_reconstruction(
    df: DataFrame,
    matrix: Sequence[Sequence[float]],
    features: Sequence[str],
    weights: Sequence[str],
    topics: Sequence[int],
    ceiling: float | None = None,
) -> DataFrame:
    """Features rebuilt from chosen topics; ``ceiling`` turns them back."""
    built = {}
    for r, f in enumerate(features):
        value = mixture(matrix, topics, weights, r)
        built[f] = F.expr(f"{number(ceiling)} - {value}" if ceiling is not None else value)
    return df.withColumns(built)


def reweighted_features(
    df: DataFrame,
    matrix: Sequence[Sequence[float]],
    features: Sequence[str],
    weights: Sequence[str],
    topics: Sequence[int],
    out: Sequence[str],
) -> DataFrame:
    """Features times the rebuilt values over their row mean."""
    built = df.withColumn("_r", F.expr(f"array({', '.join(mixture(matrix, topics, weights, r) for r in range(len(features)))})"))
    mean = F.aggregate("_r", F.lit(0.0), lambda a, v: a + v) / F.lit(float(len(features))) + F.lit(1e-8)
    built = built.withColumn("_m", mean)
    return built.withColumns(
        {o: F.expr(f"{double_of(f)} * (_r[{r}] / _m)") for r, (f, o) in enumerate(zip(features, out))}
    ).drop("_r", "_m")


def topic_masked_features(
    df: DataFrame,
    matrix: Sequence[Sequence[float]],
    features: Sequence[str],
    weights: Sequence[str],
    topics: Sequence[int],
    out: Sequence[str],
) -> DataFrame:
    """Features times their own weighted sum of chosen normalised patterns."""
    return df.withColumns(
        {
            o: F.expr(f"{double_of(f)} * {mixture(matrix, topics, weights, r)}")
            for r, (f, o) in enumerate(zip(features, out))
        }
    )


def loss_and_expected(
    df: DataFrame,
    matrix: Sequence[Sequence[float]],
    features: Sequence[str],
    weights: Sequence[str],
    topics: Sequence[int],
    means: Sequence[float],
    stds: Sequence[float],
    loss: Sequence[str],
    expected: Sequence[str],
) -> DataFrame:
    """Rebuilt score in raw units, and the reference mean less that loss."""
    added = {}
    for r in range(len(features)):
        lost = f"{mixture(matrix, topics, weights, r)} * {number(stds[r])}"
        added[loss[r]] = F.expr(lost)
        added[expected[r]] = F.expr(f"{number(means[r])} - {lost}")
    return df.withColumns(added)
