"""Out-of-fold predictions: one row per subject from the fold it was kept out of."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, quoted
from cohortloom.operators.ranking import stratified_folds
from cohortloom.runtime import settle


def run_parallel(spark, tasks: Sequence[Callable], workers: int) -> list:
    """Submit independent Spark jobs from a few driver threads, in order."""
    if workers <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    pool = ThreadPool(min(workers, len(tasks)))
    try:
        call = inheritable_thread_target(spark)
        return pool.map(lambda t: call(t)(), list(tasks))
    finally:
        pool.close()


def out_of_fold(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ids: Sequence[str],
    fit: Callable[[DataFrame], object],
    k: int = 5,
    seed: int = 42,
    workers: int = 2,
) -> DataFrame:
    """(ids, P(class)..., DX_true, DX_pred, fold), one row per labelled row.

    ``fit`` trains on a frame and returns a model with ``predict(frame)``.
    Folds are written once, so every fit sees the same split.
    """
    folded = folded_rows(df, features, label, ids, k, seed)

    def one(fold: int) -> DataFrame:
        model = fit(folded.filter(F.col("fold") != fold))
        return model.predict(folded.filter(F.col("fold") == fold))

    parts = run_parallel(df.sparkSession, [lambda f=f: one(f) for f in range(k)], workers)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return shown_predictions(whole, label, ids)


def folded_rows(df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """The labelled rows with their ``fold``, written once."""
    needed = df.selectExpr(*[quoted(c) for c in dict.fromkeys([*ids, label, *features])])
    return settle(stratified_folds(needed, label, ids, k, seed))


def shown_predictions(whole: DataFrame, label: str, ids: Sequence[str]) -> DataFrame:
    """Ids, ``P(class)`` in the order of names, true and predicted class and fold."""
    probabilities = [c for c in whole.columns if c.startswith("P(")]
    return whole.select(
        *[named(i) for i in ids],
        *[F.coalesce(named(p), F.lit(0.0)).alias(p) for p in sorted(probabilities)],
        named(label).cast("string").alias("DX_true"),
        F.col("DX_pred"),
        F.col("fold"),
    )
