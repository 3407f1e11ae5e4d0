"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents are tokenised where they are read and cut into pieces of at most ``size`` tokens; only a row per piece goes on.
The histogram of piece lengths has at most ``size`` entries, so the patterns are found on the driver: lengths go
longest first into the pack that is shortest so far, and packs alike are one pattern with a count. A pattern then says
which ranks of each length it takes, and pieces find their place by rank: the rank inside a length is a count over map
partitions plus the rank inside one partition, so no task sees all pieces of a length.

Null texts are empty: one piece with the end id only. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.bpe import Pieces, default_vocabulary, encoder_of
from cohortloom.llm.common import small_batches
from cohortloom.runtime import settle

Pattern = tuple[tuple[int, int], ...]


@functools.lru_cache(maxsize=2)
def _coded(path: str) -> Pieces:
    import tiktoken

    encoder = encoder_of(path)
    ranks = {raw: n for n, raw in enumerate(encoder.bytes_of) if raw and n not in encoder.special.values()}
    # the merges of this format are ranked by the ids they make, so a rank encoder gives the same ids
    ordinary = tiktoken.Encoding("pieces", pat_str=Pieces.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    table = Pieces(encoder, lambda ids: np.array(ids, dtype="<u4").tobytes())
    table.make = lambda piece: np.array(ordinary(piece), dtype="<u4").tobytes()
    return table


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, size: int = 1024,
           end: int = 0) -> DataFrame:
    """One row per piece: its document, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and the map partition ``part``."""
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        table = _coded(path)
        for batch in batches:
            rows = []
            for k, value in enumerate(batch.column(1)):
                raw = b"".join(table.parts(value.as_py() or "")) + tail
                total = len(raw) // 4
                for start in range(0, total, size):
                    part = raw[4 * start:4 * (start + size)]
                    rows.append((k, start, len(part) // 4, zlib.crc32(part), total))
            at, *values = (pa.array(c, pa.int64()) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *values],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return (docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
            .withColumn("part", F.spark_partition_id()))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """(pattern, number of packs) for counts of lengths; a pattern lists (length, times) in placing order.

    Lengths are placed longest first, each into a pack with the least filled; a length that fits nowhere opens packs
    and fills them with itself. Packs that are alike move together, so the work depends on the number of lengths only.
    """
    open_packs: list[tuple[int, int, Pattern, int]] = []
    done, order = [], 0
    for length in sorted(histogram, reverse=True):
        left, touched = histogram[length], []
        while left:
            if open_packs and open_packs[0][0] + length <= size:
                filled, _, pattern, packs = heapq.heappop(open_packs)
                fit = 1
            else:
                filled, pattern, fit = 0, (), size // length
                packs = max(1, left // fit)
                fit = min(fit, left)
            used = min(packs, left // fit)
            if packs > used and pattern:
                heapq.heappush(open_packs, (filled, order, pattern, packs - used))
            left -= used * fit
            grown = pattern[:-1] + ((length, pattern[-1][1] + fit),) if pattern and pattern[-1][0] == length else (*pattern, (length, fit))
            order += 1
            if filled + fit * length < size:
                heapq.heappush(open_packs, (filled + fit * length, order, grown, used))
            else:
                done.append((grown, used))
    return done + [(p, n) for _, _, p, n in sorted(open_packs)]


class Places:
    """Where the pieces of each length go, by their rank: arrays with a row per pattern and length."""

    def __init__(self, found: list[tuple[Pattern, int]]):
        rows, ranks, first = [], {}, 0
        for pattern, packs in found:
            offset = 0
            for length, times in pattern:
                rank = ranks.get(length, 0)
                rows.append((length, rank, times, first, offset))
                ranks[length] = rank + packs * times
                offset += length * times
            first += packs
        rows.sort()
        self.length, self.rank, self.times, self.first, self.offset = (
            np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [()] * 5))
        self.key = (self.length << 48) + self.rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        row = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        nth = rank - self.rank[row]
        return self.first[row] + nth // self.times[row], self.offset[row] + nth % self.times[row] * length


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, size: int = 1024,
         end: int = 0) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there."""
    found = settle(pieces(docs, id, text, path, size, end))
    counts = settle(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(patterns(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    inside = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "start"))
    ranked = (found.withColumn("inside", inside).join(offsets, ["part", "length"])
              .withColumn("rank", F.col("earlier") + F.col("inside") - 1).drop("part", "earlier", "inside"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")
