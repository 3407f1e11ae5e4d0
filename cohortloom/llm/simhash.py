"""Near duplicates by SimHash and a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most ``bits`` bits (2 by default) differ in at most ``bits`` bytes, so
they share at least ``8 - bits`` bytes in place; that is the count every linked pair reaches. The index has a posting
for each choice of that many byte positions and their values: fingerprints meet in a posting exactly if their tally
of shared positional bytes reaches the minimum. (With single bytes as keys, each of the 2048 postings would hold at least a
256th of all fingerprints, and pairing inside them would grow with the square of the input.) A posting's
members differ in ``bits`` bytes only, so it holds at most 65,536 distinct fingerprints for 2 bits, whatever the input;
the bit distance is verified inside, and a posting gives its spanning links, never all its pairs.

Null and empty texts have fingerprint zero. Copies are one fingerprint; ties and repeated rows need no rule.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import U64, give_back_id, id_column, small_batches, unused
from cohortloom.llm.components import components
from cohortloom.runtime import settle

SEED = 42


def simhash(text: str, width: int) -> int:
    """Fingerprint of the word shingles of a text (A-Z lowered, words split at space and \\t to \\r)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """A 64-bit number of the bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes.astype("<u8"), 1 + len(hashes) // 100_000):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``id`` and ``print`` (the fingerprint as a signed 64-bit number) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(t.as_py() or "", width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "print"])

    return (docs.select(id_column(id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "id long, print long"))


def _masks(bits: int) -> list[int]:
    """Masks of the byte positions left out, for each choice of positions that must agree."""
    return [sum(0xFF << (8 * p) for p in out) for out in combinations(range(8), bits)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def spanning_links(group: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least linked member) that hold each posting's linked members together.

    Members within ``bits`` are found through what they turn into when up to half of the bits, rounded up, are turned:
    for 2 bits, two members are linked exactly if turning one bit or none in each can make them equal.
    """
    own = prints.astype(U64)
    reach = (bits + 1) // 2
    flips = [0, *(sum(1 << b for b in c) for n in range(1, reach + 1) for c in combinations(range(64), n))]
    _, at = np.unique(group, return_inverse=True)
    shared = np.bitwise_or.reduceat(own, np.flatnonzero(np.diff(at, prepend=-1)))
    common = np.bitwise_and.reduceat(own, np.flatnonzero(np.diff(at, prepend=-1)))
    varied = (shared & ~common)[at]
    members, points = [], []
    for flip in map(U64, flips):
        fit = np.flatnonzero((flip & ~varied) == 0)
        members.append(fit)
        points.append(own[fit] ^ flip)
    members, points = np.concatenate(members), np.concatenate(points)
    order = np.lexsort((members, points, at[members]))
    members, points = members[order], points[order]
    same = (at[members][1:] == at[members][:-1]) & (points[1:] == points[:-1])
    a, b = members[1:][same], members[:-1][same]
    if not len(a):
        return a, b
    # join what hangs together, so that a posting gives fewer links than it has members
    root = np.arange(len(own))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(own)))
    return moved, root[moved]


def _posting_links(bits: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("members")
            prints = lists.flatten().to_numpy(zero_copy_only=False)
            group = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            a, b = spanning_links(group, prints, bits)
            yield pa.RecordBatch.from_arrays([pa.array(prints[a], pa.int64()), pa.array(prints[b], pa.int64())], ["a", "b"])

    return run


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``print``) whose components are those of all pairs within ``bits``."""
    masks = _masks(bits)
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(~m & (2**64 - 1)))).alias("shared"))
                     for k, m in enumerate(masks)])
    postings = (prints.select("print", F.explode(keys).alias("key"))
                .groupBy("key.choice", "key.shared").agg(F.sort_array(F.collect_set("print")).alias("members"))
                .filter(F.size("members") > 1))
    return postings.select("members").mapInArrow(_posting_links(bits), "a long, b long").distinct()


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` and ``component_id``. ``bits`` is even."""
    if bits % 2 or not 0 <= bits <= 4:
        raise ValueError("bits must be 0, 2 or 4")
    prints = settle(fingerprints(docs, id, text, width))
    distinct = settle(prints.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links(distinct, bits)) if bits else distinct.select(F.col("print").alias("node"), F.col("print").alias("root")).limit(0)
    rooted = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(heads, "root").select("print", "component_id"))
    return prints.join(named, "print").select(
        give_back_id("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), give_back_id("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group."""
    found = groups(docs, id, text, width, bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    (name,) = unused(docs, "_stays")
    stays = found.select(id_column("doc_id").alias(name))
    return docs.join(stays, id_column(id) == F.col(name), "left_semi")
