"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the digits of a number in base ``BASE``, taken modulo a prime. The value of two stretches joined is
``left * BASE**len(right) + right``, so long texts are cut into chunks, the chunks are hashed in parallel on any
executor, and their values combine by length. Texts with equal value and length are candidates; they are then compared
chunk by chunk: for each place the least and the greatest chunk of the group are found (map tasks send one pair each,
however large the group), and a group whose chunks all agree is a class. Should a group disagree, its members are told
apart by SHA-256.

Null texts count as empty. Repeated rows (same id, same text) are one document; one id with several texts is several
documents. A null id is the smallest id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back_id, id_column, partitions, small_batches, unused, value_buffer
from cohortloom.runtime import settle

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
#: Bytes of one chunk.
CHUNK = 1 << 16


def _place_values(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high 32 bits of BASE**i modulo PRIME, highest power first."""
    values, v = np.empty(n, dtype=np.int64), 1
    for i in range(n):
        values[n - 1 - i] = v
        v = v * BASE % PRIME
    return values & 0xFFFFFFFF, values >> 32


class Hasher:
    def __init__(self):
        self.low, self.high = _place_values(CHUNK)

    def of(self, part: np.ndarray) -> int:
        """Value of up to CHUNK bytes; the sums of products stay below 2**63."""
        digits, n = part.astype(np.int64) + 1, len(part)
        if not n:
            return 0
        return ((int(np.dot(digits, self.high[-n:])) << 32) + int(np.dot(digits, self.low[-n:]))) % PRIME


def combine(parts: list[tuple[int, int]]) -> tuple[int, int]:
    """(value, length) of stretches joined in order, each given as (value, length)."""
    return reduce(lambda a, b: ((a[0] * pow(BASE, b[1], PRIME) + b[0]) % PRIME, a[1] + b[1]), parts, (0, 0))


def _hash_chunks(batches):
    hasher = Hasher()
    for batch in batches:
        held, at = value_buffer(batch.column("part"))
        values = [hasher.of(held[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "sha", "place")), pa.array(np.diff(at), pa.int64()), pa.array(values, pa.int64())],
            ["id", "sha", "place", "size", "value"])


def _combine_chunks(batches):
    for batch in batches:
        found = [combine([(c["value"], c["size"]) for c in sorted(chunks, key=lambda c: c["place"])])
                 for chunks in batch.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("sha"), pa.array([v for v, _ in found], pa.int64()),
             pa.array([n for _, n in found], pa.int64())], ["id", "sha", "value", "size"])


def _chunked(bodies: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk: ``place`` and ``part``; an empty body has one empty chunk."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("body") - 1) / CHUNK).cast("int")))
    return (bodies.select(*keep, "body", F.explode(places).alias("place"))
            .select(*keep, "place", F.substr("body", F.col("place") * CHUNK + 1, F.lit(CHUNK)).alias("part")))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``sha`` (SHA-256 of the bytes), ``value`` and ``size`` of every document.

    Chunks of texts longer than one chunk are dealt out over all tasks; short texts are hashed where they are read.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    bodies = docs.select(id_column(id).alias("id"), body.alias("body")).withColumn("sha", F.sha2("body", 256))
    short = (bodies.filter(F.length("body") <= CHUNK)
             .select("id", "sha", F.lit(0).alias("place"), F.col("body").alias("part")))
    long = (_chunked(bodies.filter(F.length("body") > CHUNK), "id", "sha")
            .repartition(partitions(docs.sparkSession), "sha", "place"))
    hashed = short.unionByName(long).mapInArrow(_hash_chunks, "id long, sha string, place int, size long, value long")
    return (hashed.groupBy("id", "sha").agg(F.collect_set(F.struct("place", "size", "value")).alias("chunks"))
            .mapInArrow(_combine_chunks, "id long, sha string, value long, size long"))


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    prints = settle(fingerprints(docs, id, text))
    shared = settle(prints.groupBy("value", "size").agg(F.count("*").alias("members"))
                    .filter("members > 1").drop("members"))
    candidates = prints.join(shared, ["value", "size"], "left_semi").select("id", "sha", "value", "size")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    bodies = (docs.select(id_column(id).alias("id"), body.alias("body"))
              .join(candidates, "id").filter(F.sha2("body", 256) == F.col("sha")))
    unlike = settle(_chunked(bodies, "value", "size").groupBy("value", "size", "place")
                    .agg(F.min("part").alias("least"), F.max("part").alias("most"))
                    .filter("least <> most").select("value", "size", F.lit(True).alias("apart")).distinct())
    classes = prints.join(unlike, ["value", "size"], "left").withColumn(
        "apart", F.when(F.col("apart"), F.col("sha")).otherwise(""))
    groups = settle(classes.groupBy("value", "size", "apart")
                    .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    found = classes.join(groups, ["value", "size", "apart"], "left").select(
        "id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha")
    return found.select(give_back_id("id").alias("doc_id"), give_back_id("keep_id"), "group_size",
                        (F.col("id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays."""
    (name,) = unused(docs, "_stays")
    stays = duplicates(docs, id, text).filter("kept").select(id_column("doc_id").alias(name))
    return docs.join(stays, id_column(id) == F.col(name), "left_semi")
