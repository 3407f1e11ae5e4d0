"""Cohort tables dealt by subject once, so that joins and groupings by subject later move no rows.

Scores, topics, predictions and clinical columns of the same subjects are written in as many buckets each, sorted by
subject. Spark then reads bucket with bucket: a join of two of them, or a grouping by subject, has no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortloom.functions.rowwise import named
from cohortloom.runtime import fresh_path

#: Tables to be joined need the same number.
BUCKETS = 200


def by_subject(df: DataFrame, subject: str, buckets: int = BUCKETS, table: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets of ``subject``, sorted by it, and read it back from there.

    ``table`` names it in the catalog (a new name by default), ``path`` is its folder (one in the shared folder by
    default). Rows are dealt as the buckets are, so a bucket is one file. Rows without a subject share a bucket: drop
    them first if they are many.
    """
    if buckets < 1:
        raise ValueError("there must be at least one bucket")
    spark = df.sparkSession
    table = table or f"by_subject_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, named(subject))
    dealt.write.bucketBy(buckets, subject).sortBy(subject).option("path", path or fresh_path(spark, table)).saveAsTable(table)
    return spark.table(table)


def has_exchange(df: DataFrame) -> bool:
    """Whether the plan of ``df``, as it would run without adaptive changes, moves rows between tasks."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # a new frame, as the plan of one that has run is kept
        return "Exchange" in df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def drop_table(spark: SparkSession, table: str) -> None:
    """Take the table out of the catalog; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
