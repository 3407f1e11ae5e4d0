"""Near-duplicate vectors by NN-descent.

Equal vectors are one vertex. A neighbour graph is started from vectors that share a bucket of a random hyperplane table
and is then refined: the neighbours of a vertex, in either direction, are compared with each other, and each keeps the
nearest it has seen. A vertex has ``k`` neighbours; a list that is saturated, that is, full of neighbours above the
threshold, is enlarged to ``4 k``. The number of tables grows with the number of hyperplanes, so that two vectors at the
threshold share a bucket of some table with probability ``1 - MISSED`` at every size. Rounds go on while they find a notable
share of the links of vertices that aren't saturated. Vectors travel in half precision here, and neighbours below ``floor`` are not kept, since no path to a link leads through them.

The links found hold regions together. Inside a region every vertex is compared with every other in double precision, in
blocks of ``BLOCK`` by ``BLOCK`` whatever the region's size, so enlarged lists need not hold a large region's links;
the blocks count each vertex's links (weighted by the number of equal vectors) and give spanning links, and only the latter
are joined to components. Cosine is at least the threshold for every link, and no other pair is linked.

Recall is audited: vectors are taken in the order of a hash, and all their links are counted by brute force, until ``AUDITED``
of them have links, but at most ``4 k``; where links are rarer than that, every vector is audited. Recall is the mean over linked
vertices of the share of their links that was found, equal vectors counting once; it is taken over all of them and over those with
at most ``4 k`` links, and the lesser counts, so large groups don't hide what is missed elsewhere. Below the wanted recall the graph
gets twice as many tables and more rounds, up to ``attempts`` times. The last recall is logged; below ``LEAST_RECALL`` the job stops.

Vectors that are null, zero, or have null or non-finite components link with nothing, as do vectors of another length than
most (each length is compared for itself). Repeated rows of one id are one vector with as many copies. A null id is the
smallest id.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back_id, id_column, partitions, small_batches
from cohortloom.llm.components import components
from cohortloom.runtime import settle

BLOCK = 256
BUCKET = 64
AUDITED = 200
PIECE = 4096
PLACES = 1 << 40
TABLES = 24
MISSED = 0.005
LEAST_RECALL = 0.9
log = logging.getLogger(__name__)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1) if blobs else np.empty((0, 0), kind)


def _by_length(sizes: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vertices(batches):
    """Valid vectors as blobs: in full, and scaled to length 1 in half precision."""
    for batch in batches:
        ids, full, half = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            if v is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i), full.append((x + 0.0).tobytes()), half.append(_unit(x[None])[0].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(full, pa.binary()), pa.array(half, pa.binary())], ["id", "full", "half"])


def tables_for(bits: int, threshold: float) -> int:
    """How many tables two vectors at the threshold need to share a bucket with probability ``1 - MISSED``."""
    shared = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return TABLES if shared >= 1 else max(TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-shared))))


def _tables(seed: list[int], tables: int, bits: int):
    """Bucket keys of each vertex, one a table, and its place along a further direction."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(b) for b in batch.column("half").to_pylist()])
            for rows in _by_length(sizes):
                part = batch.take(pa.array(rows))
                x = _matrix(part.column("half"), "<f2").astype(np.float32)
                planes = np.random.default_rng([*seed, x.shape[1]]).normal(size=(x.shape[1], tables * (bits + 1))).astype(np.float32)
                side = (x @ planes).reshape(len(x), tables, bits + 1)
                key = ((side[:, :, :bits] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                key = (np.arange(tables, dtype=np.int64) << 48) + (np.int64(x.shape[1] % 4096) << 36) + key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), pa.array(side[:, :, bits].ravel().astype(np.float64)), *(part.column(c).take(
                        pa.array(np.repeat(np.arange(len(x)), tables))) for c in ("v", "half"))], ["key", "along", "v", "half"])

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (less id, greater id, cosine) of a few vectors: each one's ``k`` nearest from ``floor`` on."""
    near = x @ x.T
    np.fill_diagonal(near, -2)
    if len(ids) > k + 1:
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        near = np.where(near >= least[:, None], near, -2)
    a, b = np.nonzero(near >= floor)
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), near[a, b]


def _pairs_out(found: list) -> pa.RecordBatch:
    a, b, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(s[head].astype(np.float32))], ["a", "b", "s"])


def _groups(batches, key: str):
    """Runs of rows with one key, from rows in order of it; a run may be cut where a batch ends."""
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if len(keys):
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            yield batch, list(zip(edges[:-1], edges[1:]))


def _start(k: int, floor: float):
    def run(batches):
        for batch, runs in _groups(batches, "key"):
            ids, x, found = batch.column("v").to_numpy(), batch.column("half").to_pylist(), []
            for a, b in runs:
                for first in range(a, b, BUCKET):
                    last = min(first + BUCKET, b)
                    if last - first > 1:
                        found.append(_nearest(ids[first:last], np.frombuffer(b"".join(x[first:last]), "<f2").reshape(last - first, -1).astype(np.float32), k, floor))
            yield _pairs_out(found)

    return run


def _refine(k: int, floor: float):
    """Compare the neighbours of a vertex with each other; its rows stand together."""

    def run(batches):
        for batch, runs in _groups(batches, "u"):
            ids, x, found = batch.column("v").to_numpy(), batch.column("half").to_pylist(), []
            for a, b in runs:
                if b - a > 1:
                    found.append(_nearest(ids[a:b], np.frombuffer(b"".join(x[a:b]), "<f2").reshape(b - a, -1).astype(np.float32), k, floor))
            yield _pairs_out(found)

    return run


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "s").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "s"))


def _lists(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Each vertex's nearest neighbours (u, v, s): ``k``, or up to ``4 k`` of those above the threshold."""
    nearest = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    ranked = _both(edges).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= 4 * k)
    return ranked.filter((F.col("rank") <= k) | (F.col("s") >= threshold)).drop("rank")


def _degrees(edges: DataFrame, threshold: float) -> DataFrame:
    return settle(_both(edges.filter(F.col("s") >= threshold)).groupBy("u").agg(F.count("*").alias("n")))


def _growth(before: DataFrame, now: DataFrame, saturated: int) -> float:
    """The mean share of new links, over linked vertices that weren't saturated before."""
    old = F.coalesce("old", F.lit(0))
    return now.join(before.withColumnRenamed("n", "old"), "u", "left").filter(old < saturated).agg(F.avg((F.col("n") - old) / F.col("n"))).first()[0] or 0.0


def graph(vertices: DataFrame, threshold: float, k: int, floor: float, tables: int, bits: int, seed: int, edges: DataFrame | None,
          rounds: int = 6) -> DataFrame:
    """Edges (a < b, cosine s) of the refined neighbour graph; ``edges`` are those known before."""
    spark = vertices.sparkSession
    n = partitions(spark)
    halves = vertices.select("v", "half")
    now = edges
    for first in range(0, tables, TABLES):
        keyed = settle(halves.mapInArrow(_tables([seed, first], min(TABLES, tables - first), bits), "key long, along double, v long, half binary"))
        started = (keyed.repartitionByRange(n, "key", "along").sortWithinPartitions("key", "along")
                   .mapInArrow(_start(k, floor), "a long, b long, s float"))
        now = started if now is None else started.unionByName(now)
        now = settle(now.groupBy("a", "b").agg(F.max("s").alias("s")))
    degrees = _degrees(now, threshold)
    for _ in range(rounds):
        near = _lists(now, k, threshold)
        vectors = near.select("u", "v").join(halves, "v")
        seen = (vectors.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_refine(k, floor), "a long, b long, s float"))
        kept = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "s")
        linked = now.filter(F.col("s") >= threshold)
        now = settle(kept.unionByName(seen).unionByName(linked).groupBy("a", "b").agg(F.max("s").alias("s")))
        before, degrees = degrees, _degrees(now, threshold)
        if _growth(before, degrees, 4 * k) <= 0.01:
            break
    return now


def _blocks(threshold: float):
    """Links inside a pair of blocks of a region: each vertex's weighted and plain counts, and spanning links."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.RecordBatch):
            ids, weight, block = (table.column(c).to_numpy() for c in ("v", "copies", "block"))
            counts, plain, a, b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [], []
            sizes = np.array([len(x) for x in table.column("full").to_pylist()])
            for rows in _by_length(sizes):
                x = _unit(_matrix(table.column("full").take(pa.array(rows)), "<f8"))
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if block[rows].min() != block[rows].max():
                    near &= block[rows][:, None] != block[rows][None]
                counts[rows], plain[rows] = near @ weight[rows], near.sum(axis=1)
                # the least vertex that each one reaches
                root = np.arange(len(rows))
                while True:
                    new = np.where(near, root[None], len(rows)).min(axis=1, initial=len(rows))
                    new = np.minimum(root, new)
                    new = new[new]
                    if np.array_equal(new, root):
                        break
                    root = new
                moved = np.flatnonzero(root != np.arange(len(rows)))
                a.append(ids[rows][moved]), b.append(ids[rows][root[moved]])
            moved, roots = np.concatenate(a), np.concatenate(b)
            linked = counts > 0
            none, edge = np.zeros(len(moved), np.int64), np.concatenate([np.zeros(int(linked.sum()), bool), np.ones(len(moved), bool)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[linked], moved])), pa.array(np.concatenate([counts[linked], none])), pa.array(np.concatenate([plain[linked], none])),
                 pa.array(np.concatenate([np.zeros(int(linked.sum()), np.int64), roots])), pa.array(edge)], ["v", "n", "plain", "root", "edge"])

        last = None
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for first, end in zip(edges[:-1], edges[1:]):
                if first == end:
                    continue
                if held and keys[first] != last:
                    yield work(pa.concat_batches(held))
                    held.clear()
                held.append(batch.slice(first, end - first))
                last = keys[first]
        if held:
            yield work(pa.concat_batches(held))

    return run


def verify(vertices: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Rows (v, n, plain, root, edge): exact link counts, with and without copies, and spanning links (v, root), inside the regions that ``edges`` hold together."""
    n = partitions(vertices.sparkSession)
    regions = settle(components(edges))
    sizes = settle(regions.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = (regions.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .select(F.col("node").alias("v"), "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    rows = placed.select("v", pair.alias("pair"), "block").join(vertices.select("v", "copies", "full"), "v")
    return settle(rows.repartition(n, "pair").sortWithinPartitions("pair").select("v", "pair", "block", "copies", "full")
                  .mapInArrow(_blocks(threshold), "v long, n long, plain long, root long, edge boolean"))


def _truth(vertices: DataFrame, asked: np.ndarray, blobs: list[bytes], threshold: float) -> DataFrame:
    """(v, truth): how many other vertices each of the asked ones is linked with, by brute force; those with none have no row."""

    def brute(batches):
        total = np.zeros(len(asked), np.int64)
        by = {n: [i for i, b in enumerate(blobs) if len(b) == n] for n in {len(b) for b in blobs}}
        unit = {n: _unit(np.frombuffer(b"".join(blobs[i] for i in mine), "<f8").reshape(len(mine), -1)) for n, mine in by.items()}
        for batch in batches:
            sizes = np.array([len(b) for b in batch.column("full").to_pylist()])
            for rows in _by_length(sizes):
                n = int(sizes[rows[0]])
                if n in by:
                    x = _unit(_matrix(batch.column("full").take(pa.array(rows)), "<f8"))
                    near = (unit[n] @ x.T >= threshold) & (asked[by[n]][:, None] != batch.column("v").to_numpy()[rows][None])
                    total[by[n]] += near.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(asked[total > 0]), pa.array(total[total > 0])], ["v", "n"])

    return vertices.select("v", "full").mapInArrow(brute, "v long, n long").groupBy("v").agg(F.sum("n").alias("truth"))


def audit(vertices: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED, few: int = 48) -> float:
    """Mean share of a linked vertex's true links that ``counts`` (v, plain) has: over all, or over those of at most ``few`` links if less."""
    n = vertices.count()
    place = F.pmod(F.xxhash64("v", F.lit("audit")), F.lit(PLACES))
    linked, found, sparse, sparse_found, first, size = 0, 0.0, 0, 0.0, 0, audited
    while n and first < PLACES and sparse < audited:
        end = min(PLACES, first + max(1, PLACES * size // n))
        sample = vertices.filter((place >= first) & (place < end)).select("v", "full").toArrow()
        first, size = end, min(2 * size, PIECE)
        if not sample.num_rows:
            continue
        true = _truth(vertices, sample.column("v").to_numpy(), sample.column("full").to_pylist(), threshold).filter("truth > 0")
        share = F.least("truth", F.coalesce("plain", F.lit(0))) / F.col("truth")
        low = F.col("truth") <= few
        got = true.join(counts.select("v", "plain"), "v", "left").agg(
            F.count("*").alias("linked"), F.sum(share).alias("found"), F.count(F.when(low, 1)).alias("sparse"), F.sum(F.when(low, share)).alias("sparse_found")).first()
        linked, found = linked + got.linked, found + (got.found or 0.0)
        sparse, sparse_found = sparse + got.sparse, sparse_found + (got.sparse_found or 0.0)
    log.info("%d linked vectors audited, %d of them with at most %d links", linked, sparse, few)
    return min([f / m for f, m in ((found, linked), (sparse_found, sparse)) if m], default=1.0)


def near_duplicates(table: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, k: int = 12,
                    floor: float | None = None, tables: int | None = None, recall: float = 0.97, attempts: int = 3) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``."""
    spark = table.sparkSession
    small_batches(spark)
    floor = threshold - 0.25 if floor is None else floor
    rows = table.select(id_column(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    valid = settle(rows.mapInArrow(_vertices, "id long, full binary, half binary"))
    vertices = settle(valid.groupBy("full").agg(F.min("id").alias("v"), F.count("*").alias("copies"), F.first("half").alias("half")))
    bits = min(30, max(1, int(np.log2(max(2, vertices.count() / 16)))))
    tables = tables_for(bits, threshold) if tables is None else tables
    edges, checked, counts = None, None, None
    for attempt in range(attempts):
        edges = graph(vertices, threshold - 0.01, k, floor, tables << attempt, bits, attempt, edges)
        checked = verify(vertices, edges.filter(F.col("s") >= threshold - 0.01).select("a", "b"), threshold)
        counts = settle(checked.filter("not edge").groupBy("v").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain")))
        reached = audit(vertices, counts, threshold, few=4 * k)
        log.info("attempt %d: recall %.4f", attempt + 1, reached)
        if reached >= recall:
            break
    else:
        if reached < LEAST_RECALL:
            raise RuntimeError(f"recall {reached:.4f} is below {LEAST_RECALL} after {attempts} attempts")
        log.warning("recall %.4f is below %.4f", reached, recall)
    roots = components(checked.filter("edge").select(F.col("v").alias("a"), F.col("root").alias("b")))
    named = (vertices.select("full", "v", "copies").join(roots.withColumnRenamed("node", "v"), "v", "left").join(counts.select("v", "n"), "v", "left")
             .select("full", F.coalesce("root", "v").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")))
    found = valid.select("id", "full").join(settle(named), "full").select("id", "component", "links")
    lone = rows.select("id").join(valid.select("id").distinct(), "id", "left_anti").select(
        "id", F.col("id").alias("component"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(lone).select(
        give_back_id("id").alias("vec_id"), F.col("links").alias("n_links"), give_back_id("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"))
