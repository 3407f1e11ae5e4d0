"""What the corpus operators share: Arrow batches of texts and hash helpers.

Document ids are integers. A null id is carried as ``NO_ID`` inside an operator and given back as null.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
#: Bytes of text that a Python task works on at a time, unless a single text is longer.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "cohortloom.zip")
    with zipfile.ZipFile(path, "w") as held:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    held.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Ship the code, and keep Arrow batches small, so that a batch of very long texts fits in a Python worker."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def give_back_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names made of the stems that ``df`` does not have, whatever their case."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem)
        names.append(stem)
    return names


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts as single bytes if they all fit, else as 32-bit numbers."""
    return values.astype(np.uint8 if values.max(initial=0) < 256 else np.uint32)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def value_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset:]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held, at.astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], id_name: str, text_name: str,
           limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(ids, bytes, offsets, rows) of runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        ids = batch.column(id_name).to_numpy(zero_copy_only=False)
        held, at = value_buffer(batch.column(text_name))
        first = 0
        while first < len(ids):
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(ids))
            yield (ids[first:last], held[at[first]:at[last]], at[first:last + 1] - at[first],
                   batch.slice(first, last - first))
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads them."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


BASE = 0x5851F42D4C957F2D


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; a worker keeps the longest tables asked for."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        steps = np.empty(max(n, 1 << 12), dtype=U64)

        def table(b: int) -> np.ndarray:
            steps[:] = b
            steps[0] = 1
            return np.cumprod(steps, dtype=U64)

        _POWERS[base] = table(base), table(pow(base, -1, 2**64))
    up, down = _POWERS[base]
    return up[:n], down[:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray, base: int = BASE):
        up, self.down = powers(len(codes) + 1, base)
        self.sums = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Hash of each run of ``width`` codes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=U64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def word_bounds(held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words (runs outside space and \\t to \\r) of concatenated texts; no word crosses texts."""
    gap = (held == 0x20) | ((held >= 0x09) & (held <= 0x0D))
    inside = np.zeros(len(held) + 2, dtype=np.int8)
    inside[1:-1] = ~gap
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    edges = at[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < len(held))])
    if len(edges):
        cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def word_codes(held: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word; equal words have equal codes."""
    return Rolling(held.astype(U64) + U64(1)).of(start, end) + (end - start).astype(U64)
