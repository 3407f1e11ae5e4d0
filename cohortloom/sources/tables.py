"""Cohort tables in and out of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortloom.functions.rowwise import named
from cohortloom.operators.columns import rename_by


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; empty fields are missing.

    Pass a schema for large files: without one the types are inferred by an
    extra pass over the file.
    """
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV whose first column, often unnamed, becomes the row key."""
    return name_first_column(read_csv(spark, path, schema), key)


def name_first_column(df: DataFrame, key: str) -> DataFrame:
    return rename_by(df, {df.columns[0]: key})


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_csv(spark, path) if format == "csv" else spark.read.format(format).load(path)


def header_names(df: DataFrame) -> DataFrame:
    """First data row as (region_pos, name): the display names."""
    first = df.limit(1)
    values = F.array(*[named(c).cast("string") for c in df.columns])
    return first.select(F.posexplode(values).alias("region_pos", "name"))


def write_csv(df: DataFrame, path: str, key: str | None = None) -> str:
    """CSV directory with headers; ``key`` is put first as the row key.

    Files follow the partitions, so writing stays parallel.
    """
    if key is not None:
        df = df.select(named(key), *[named(c) for c in df.columns if c != key])
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
