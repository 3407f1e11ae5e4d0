"""CSV with typed cells: types from all files, and a table of the cells that don't fit.

Types are inferred by one mergeable aggregate over all cells, wide tables included. Cells are cast one by one, so a bad
cell is missing in the rows and listed, with file, line, column and text, in the rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.rowwise import named, quoted
from cohortloom.runtime import bounded_rows

# Narrowest first; each fits what its text pattern and the cast accept. A date is a timestamp, an integer a double.
PATTERNS = {
    "bigint": "^[+-]?[0-9]+$",
    "double": "^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)$",
    "date": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    "timestamp": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9].*)?$",
    "boolean": "^([tT][rR][uU][eE]|[fF][aA][lL][sS][eE])$",
}
MAX_COLUMNS = 1_000_000


def _cells(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first file; unnamed and repeated ones are numbered."""
    return spark.read.option("header", True).csv(path).columns


def infer_types(cells: DataFrame, bad_share: float = 0.0) -> StructType:
    """The narrowest type of each string column that at least ``1 - bad_share`` of its cells fit.

    Columns without cells, and those that fit nothing, are strings. Counts per column and type add up over files and
    tasks, so the result doesn't depend on how the input is split.
    """
    names = cells.columns
    long = cells.select(F.posexplode(F.expr("array(" + ", ".join(quoted(n) for n in names) + ")")).alias("pos", "v"))
    fits = [
        F.count_if(F.expr(f"v RLIKE '{p}' AND try_cast(v AS {kind}) IS NOT NULL")).alias(kind)
        for kind, p in PATTERNS.items()
    ]
    found = bounded_rows(long.filter("v IS NOT NULL").groupBy("pos").agg(F.count("*").alias("n"), *fits), MAX_COLUMNS, "columns")
    kinds = {r["pos"]: next((k for k in PATTERNS if r[k] >= (1.0 - bad_share) * r["n"]), "string") for r in found}
    return StructType.fromDDL(", ".join(f"{quoted(n)} {kinds.get(i, 'string')}" for i, n in enumerate(names)))


def read_typed_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, bad_share: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the CSV files with headers at ``path``.

    ``schema`` gives the columns in the files' order; without one they are inferred (``infer_types``). Empty fields are
    missing and never rejected. Rejects are (file, line, column, text): a cell that its type doesn't hold is missing in
    the rows; a line with too few or too many cells has a null ``column`` and the whole line as ``text``, and keeps in the
    rows what it has. ``line`` counts from 1, header and blank lines included. Fields with line breaks are not supported, and
    the files must not change while the rejects are computed.
    """
    if schema is None:
        schema = infer_types(_cells(spark, path, header(spark, path)), bad_share)
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    cells = _cells(spark, path, list(kinds))
    rows = cells.selectExpr(*[quoted(n) if k == "string" else f"try_cast({quoted(n)} AS {k}) AS {quoted(n)}" for n, k in kinds.items()])
    return rows, _rejects(spark, path, kinds)


def _misfits(at: list[tuple[int, str]], kind: str) -> Column:
    """The (column, text) of the cells ``p.c<i>`` that are there and aren't of type ``kind``."""
    texts, names = F.array(*[F.col(f"p.c{i}") for i, _ in at]), F.lit([n for _, n in at])
    made = F.transform(texts, lambda t, i: F.struct(F.get(names, i).alias("column"), t.alias("text")))
    return F.filter(made, lambda cell: cell["text"].isNotNull() & cell["text"].try_cast(kind).isNull())


def _rejects(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    # one row for each piece of a file that a task read; lines before it come from the pieces before
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        lines.groupBy("file", "start")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(F.col("file").alias("_file"), F.col("start").alias("_start"), "first", "before")
    )
    fields = ", ".join(f"c{i} string" for i in range(len(kinds)))
    options = {"nullValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "whole"}
    parsed = lines.withColumn("p", F.from_csv("value", f"{fields}, whole string", options))
    bad = []
    for kind in dict.fromkeys(kinds.values()):
        if kind == "string":
            continue
        bad.append(_misfits([(i, n) for i, (n, k) in enumerate(kinds.items()) if k == kind], kind))
    none = F.expr("CAST(array() AS array<struct<column:string,text:string>>)")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("value").alias("text")))
    found = F.when(F.col("p.whole").isNotNull(), whole).otherwise(F.concat(none, *bad))
    rejected = (
        parsed.filter("trim(value) <> ''")
        .select("file", "start", "place", F.explode(found).alias("r"))
        .select("file", "start", "place", "r.column", "r.text")
    )
    numbered = rejected.join(pieces, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    return numbered.select(
        "file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), named("column"), "text"
    ).filter("line > 1")
