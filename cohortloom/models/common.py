"""Shared parts of the model fits."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from cohortloom.functions.rowwise import double_of, quoted
from cohortloom.operators.columns import feature_vector


def matrix_input(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only the feature block, as one array column ``x``."""
    return df.select(feature_vector(features, clip=False).alias("x"))


# Partial sums that the driver adds up itself, in number and in bytes; more are first added in tasks.
DIRECT_PARTS = 64
DIRECT_BYTES = 64 << 20


def cached(df: DataFrame) -> DataFrame:
    """Keep the input of an iterative fit; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_input(df: DataFrame, features: Sequence[str], nonnegative: bool = False) -> DataFrame:
    """The cached feature block of a fit, refused if a value is missing.

    One aggregate names the columns with null or NaN values and, with
    ``nonnegative``, those with values below zero.
    """
    x = cached(matrix_input(df, features))
    value = F.col("v")
    checks = [F.max(value.isNull() | F.isnan(value)).alias("missing"), F.max(value < 0).alias("negative")]
    bad = (
        x.select(F.posexplode("x").alias("pos", "v"))
        .groupBy("pos")
        .agg(*checks)
        .filter("missing" + (" OR negative" if nonnegative else ""))
        .collect()
    )
    if bad:
        x.unpersist()
        for kind in ("missing", "negative"):
            names = [features[r["pos"]] for r in sorted(bad, key=lambda r: r["pos"]) if r[kind]]
            if names and (kind == "missing" or nonnegative):
                raise ValueError(f"{kind} values in {', '.join(names)}")
    return x


def sum_over_rows(
    x: DataFrame, length: int, step: Callable[[np.ndarray], np.ndarray], column: str = "x"
) -> np.ndarray:
    """Sum ``step(batch)`` (a flat array of ``length``) over all batches."""
    return fold_over_rows(x, length, step, lambda a, b: a + b, column)


def fold_over_rows(
    x: DataFrame, length: int, step: Callable[[np.ndarray], np.ndarray],
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str = "x"
) -> np.ndarray:
    """Merge ``step(batch)`` (a flat array of ``length``) of all batches; zeros if there are none.

    Every task emits one partial array. Up to ``DIRECT_PARTS`` of them with at
    most ``DIRECT_BYTES`` in all are merged on the driver; more are merged in
    tasks first, level by level, so the driver never holds more than that
    whatever the number of tasks (two at least, if one is that large).
    """
    from cohortloom.models.kernels import as_list_column, batch_matrix

    def merging(name: str, of: Callable[[np.ndarray], list]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for part in of(batch_matrix(batch, name)) if batch.num_rows else []:
                    total = part if total is None else merge(total, part)
            if total is not None:
                yield pa.RecordBatch.from_arrays([as_list_column(total[None, :])], names=["s"])

        return run

    parts = x.select(column).mapInArrow(merging(column, lambda m: [step(m)]), "s array<double>")
    count = getattr(x, "_part_count", None)
    if count is None:
        count = x._part_count = x.rdd.getNumPartitions()
    direct = max(2, min(DIRECT_PARTS, DIRECT_BYTES // (8 * max(length, 1))))
    while count > direct:
        count = -(-count // direct)
        parts = parts.repartition(count).mapInArrow(merging("s", list), "s array<double>")
    total = np.zeros(length)
    for k, part in enumerate(batch_matrix(parts.toArrow().combine_chunks(), "s").reshape(-1, length)):
        total = part if k == 0 else merge(total, part)
    return total


def map_rows(
    df: DataFrame, features: Sequence[str], step: Callable[[np.ndarray], np.ndarray], names: Sequence[str]
) -> DataFrame:
    """Add columns ``names`` computed per row from the feature block.

    No shuffle; the other columns pass through.
    """
    from cohortloom.models.kernels import as_list_column, batch_matrix

    kept = [c for c in df.columns if c not in names]
    # as text: of a wide table each column would be several calls to the JVM
    block = ", ".join(double_of(f) for f in features)
    fed = df.selectExpr(*[quoted(c) for c in kept], f"array({block}) AS _x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = as_list_column(step(batch_matrix(batch, "_x")))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, made], names=[*batch.schema.names[:-1], "_y"])

    schema = StructType([*fed.schema.fields[:-1], StructField("_y", ArrayType(DoubleType()))])
    made = fed.mapInArrow(run, schema)
    return made.selectExpr(*[quoted(c) for c in kept], *[f"_y[{i}] AS {quoted(n)}" for i, n in enumerate(names)])


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_matrix(spark: SparkSession, path: str, matrix: np.ndarray) -> None:
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    spark.createDataFrame(rows, "row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["row"])
    return np.array([r["values"] for r in rows])
