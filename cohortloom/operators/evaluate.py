"""Confusion tables, accuracy, reports, class weights and label codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named
from cohortloom.operators.ranking import class_list
from cohortloom.runtime import join_small, small_local


def confusion_counts(df: DataFrame, observed: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """(observed, predicted, n, share) for every pair of listed labels.

    Pairs that never occur are 0; ``share`` is within the observed label and
    0 where that label has no rows.
    """
    spark = df.sparkSession
    grid = spark.createDataFrame([(o, p) for o in labels for p in labels], "observed string, predicted string")
    counts = (
        df.select(named(observed).cast("string").alias("observed"), named(predicted).cast("string").alias("predicted"))
        .filter(F.col("observed").isin(*labels) & F.col("predicted").isin(*labels))
        .groupBy("observed", "predicted")
        .agg(F.count("*").alias("n"))
    )
    # one scan: the counted cells are at most the grid
    counts = small_local(counts, len(labels) ** 2)
    filled = F.broadcast(grid).join(counts, ["observed", "predicted"], "left").na.fill(0, ["n"])
    totals = counts.groupBy("observed").agg(F.sum("n").alias("_t"))
    return (
        filled.join(totals, ["observed"], "left")
        .withColumn("share", F.coalesce(F.col("n") / F.col("_t"), F.lit(0.0)))
        .drop("_t")
    )


def reorder_labels(classes: Sequence[str], order: Sequence[str]) -> list[str]:
    """``order`` if it is a permutation of ``classes``, else an error."""
    if len(order) != len(classes) or set(order) != set(classes):
        raise ValueError(f"{list(order)} is not a reordering of {list(classes)}")
    return list(order)


def accuracy(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Share of equal labels among rows that have both."""
    both = df.filter(named(observed).isNotNull() & named(predicted).isNotNull())
    return both.agg(
        F.avg((named(observed) == named(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n")
    )


def classification_report(df: DataFrame, observed: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Per label, then macro, weighted and accuracy rows; 0/0 counts as 0.

    Each input row is read as two label events and summed per label. The
    accuracy row is over all rows that have both labels, listed or not.
    """
    both = df.filter(named(observed).isNotNull() & named(predicted).isNotNull())
    event = F.explode(
        F.array(
            F.struct(named(observed).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"),
                     (named(observed) == named(predicted)).cast("int").alias("h")),
            F.struct(named(predicted).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("h")),
        )
    )
    seen = (
        both.select(event.alias("e"))
        .groupBy(F.col("e.label").alias("label"))
        .agg(F.sum("e.s").alias("support"), F.sum("e.p").alias("_p"), F.sum("e.h").alias("_h"))
    )
    listed = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in labels], "label string"))
    # one scan: the sums have one row per listed label
    sums = small_local(listed.join(seen, ["label"], "left").na.fill(0, ["support", "_p", "_h"]), len(labels))
    precision = F.coalesce(F.try_divide(F.col("_h"), F.col("_p")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("_h"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("_h"), F.col("_p") + F.col("support")), F.lit(0.0))
    per = sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "_h")

    def summary(name: str, weighted: bool) -> DataFrame:
        def mean(c: str):
            if weighted:
                share = F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
                return F.coalesce(share, F.lit(0.0)).alias(c)
            return F.avg(c).alias(c)

        return per.agg(*[mean(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(
            F.lit(name).alias("label"), "precision", "recall", "f1", "support"
        )

    share, count = F.col("accuracy"), F.col("n")
    overall = accuracy(df, observed, predicted).select(F.coalesce(share, F.lit(0.0)).alias("a"), count.alias("support")).select(
        F.lit("accuracy").alias("label"),
        F.col("a").alias("precision"),
        F.col("a").alias("recall"),
        F.col("a").alias("f1"),
        "support",
    )
    return (
        per.drop("_h")
        .unionByName(summary("macro avg", False))
        .unionByName(summary("weighted avg", True))
        .unionByName(overall)
    )


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add ``rows / (classes * rows of the class)``; unlabelled rows get none."""
    counts = df.filter(named(label).isNotNull()).groupBy(named(label)).agg(F.count("*").alias("_n"))
    everything = W.partitionBy()  # over one row per class
    weights = counts.select(
        named(label), (F.sum("_n").over(everything) / (F.count("*").over(everything) * F.col("_n"))).alias(out)
    )
    return join_small(df, weights, [label], "left")


def encode_labels(df: DataFrame, label: str, out: str = "label_code") -> tuple[DataFrame, list[str]]:
    """Add the class number in sorted order; also return the classes."""
    classes = class_list(df, label)
    place = F.array_position(F.lit(classes), named(label).cast("string"))
    return df.withColumn(out, F.when(place > 0, place - 1).cast("int")), classes


def decode_labels(df: DataFrame, code: str, classes: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.get(F.lit(list(classes)), named(code)))
