"""Passages that repeat across or inside documents: the parts that word and byte repeats share.

A document is a sequence of units (words or bytes); a window is ``span`` consecutive units of one document. Wanted are the
windows whose content also starts earlier: in a document with a smaller id, or earlier in the same one.

Only few places of a text are looked at. Of the grams (``gram`` units) inside a window the one with the least hash, the
leftmost on ties, is its anchor. That choice depends on the window's content alone, so equal windows have equal anchors at
the same place. Windows in a row with one anchor form a segment. The passes:

1. ``candidates``: hashes of anchor grams are counted; an anchor whose gram occurs once is done, its windows are unique.
2. ``segments``: texts meet the places of their remaining anchors and give the segments there. Within a task equal
   segments are reduced to the earliest one, so a passage that all documents share is sent once a task.
3. an operator's own engine finds the repeated windows among the segments of an anchor.
4. ``covered``: texts meet the windows found, which ends in one row per document.

An anchor with more than ``heavy`` segments, such as one at the edge of a passage that very many documents share, would make
one large group. Its windows are sent one by one to the bucket of their own content instead, each once a task. The list of
such grams is at most ``MAX_HEAVY`` long; a gram that isn't among the most frequent that many has at most that part of
all anchors.

What tasks exchange are rows (bucket, kind, doc, blob) whose blobs hold whole arrays, sorted and compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import U64, Rolling, SLICE_BYTES, id_column, mix, partitions, slices, small_batches, word_bounds, word_codes
from cohortloom.runtime import settle

ROWS = "bucket int, kind int, doc long, blob binary"
#: Kinds of rows: places of anchors or windows, texts; segments, single windows, windows already known to repeat.
PLACES, TEXT, SEGMENTS, SINGLE, KNOWN = range(5)
HEAVY = 20_000
MAX_HEAVY = 1 << 20
#: Anchors and segments that a task gathers before it sends them.
GATHER_ANCHORS = 1_000_000
GATHER_SEGMENTS = 100_000
LOW = U64(0xFFFFFFFF)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        kind = a.dtype.str.encode().ljust(8)
        parts += [kind, np.array([a.nbytes], "<i8").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, found = 8 + 16 * n, []
    for k in range(n):
        kind = raw[8 + 16 * k:16 + 16 * k].decode().strip()
        size = int(np.frombuffer(raw, "<i8", 1, 16 + 16 * k)[0])
        found.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return found


def rows_out(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                      ["bucket", "kind", "doc", "blob"])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of 64-bit hashes, so keys in order are in order of their buckets."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(docs.astype(np.int64).view(U64) + U64(1)), buckets)


@dataclass(frozen=True)
class Shape:
    """What is compared: ``words`` or bytes, ``span`` units a window, ``gram`` units an anchor."""

    words: bool
    span: int
    gram: int


class Texts:
    """The units of several texts in a row. ``at`` has the first unit of each text; ``start`` and ``end`` units' bytes."""

    def __init__(self, shape: Shape, held: np.ndarray, at: np.ndarray):
        self.held = held
        if shape.words:
            self.start, self.end = word_bounds(held, at)
            self.codes = word_codes(held, self.start, self.end)
            self.at = np.searchsorted(self.start, at).astype(np.int64)
        else:
            self.codes = BYTE_CODES[held]
            self.at = at
            self.start = np.arange(len(held), dtype=np.int64)
            self.end = self.start + 1


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03))


@dataclass
class Segments:
    """Windows ``first``..``last`` (unit numbers in Texts) that have the anchor ``anchor`` with hash ``gram``; ``text`` is the number of the text."""

    gram: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray


def segments_of(shape: Shape, texts: Texts) -> tuple[Segments, Rolling]:
    rolling, n, width = Rolling(texts.codes), len(texts.codes), shape.span - shape.gram + 1
    if n < shape.span:
        none = np.empty(0, np.int64)
        return Segments(none.astype(U64), none, none, none, none), rolling
    grams = rolling.every(shape.gram)
    least, done = (grams & ~LOW) | np.arange(len(grams), dtype=U64), 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[:len(least) - (width - done)], least[width - done:])
    sizes = np.diff(texts.at)
    text = np.repeat(np.arange(len(sizes)), sizes)
    window = np.flatnonzero(texts.at[1:][text[:len(least)]] - np.arange(len(least)) >= shape.span)
    anchor = (least[window] & LOW).astype(np.int64)
    if not len(anchor):
        return Segments(anchor.astype(U64), anchor, anchor, anchor, anchor), rolling
    cut = np.flatnonzero(np.diff(anchor)) + 1
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(anchor) - 1]])
    anchor = anchor[head]
    # anchors have small hashes; mixed again they fall evenly into buckets
    return Segments(mix(grams[anchor]), anchor, window[head], window[tail], text[anchor]), rolling


def _anchors(shape: Shape, buckets: int):
    """Pass 1, map: hashes of anchors by bucket, and the places of those that repeat within the task."""

    def flush(gram, doc, place, spread):
        order = np.argsort(gram, kind="stable")
        gram, doc, place = gram[order], doc[order], place[order]
        head = np.flatnonzero(np.diff(gram, prepend=gram[0] ^ U64(1)) != 0)
        count = np.diff(head, append=len(gram))
        rows, again = [], np.repeat(count > 1, count)
        g, d, p, c = gram[head], doc[head], place[head], count.astype(np.uint32)
        edges = np.searchsorted(bucket_of(g, buckets), np.arange(buckets + 1))
        for b in range(buckets):
            part = slice(edges[b], edges[b + 1])
            if edges[b] < edges[b + 1]:
                rows.append((b, SEGMENTS, 0, squeeze(np.diff(g[part], prepend=U64(0)), c[part], d[part], p[part])))
        if again.any():
            rows.append((spread % buckets, KNOWN, 0, squeeze(doc[again], place[again])))
        return rows_out(rows)

    def run(batches):
        kept, held_n, spread = [], 0, 0
        for ids, held, at, _ in slices(batches, "id", "text"):
            texts = Texts(shape, held, at)
            found, _ = segments_of(shape, texts)
            if len(found.gram):
                kept.append((found.gram, ids[found.text].astype(np.int64), (found.anchor - texts.at[found.text]).astype(np.uint32)))
                held_n += len(found.gram)
                spread = int(found.gram[0] % U64(1 << 30))
            if held_n >= GATHER_ANCHORS:
                yield flush(*(np.concatenate(c) for c in zip(*kept)), spread)
                kept, held_n = [], 0
        if kept:
            yield flush(*(np.concatenate(c) for c in zip(*kept)), spread)

    return run


def _by_document(kind: int, buckets: int, doc: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows (bucket of the document, kind, 0, blob of doc and columns)."""
    bucket = doc_bucket(doc, buckets)
    order = np.lexsort((columns[0], doc, bucket))
    doc, columns = doc[order], [c[order] for c in columns]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, kind, 0, squeeze(np.diff(doc[edges[b]:edges[b + 1]], prepend=0), *(c[edges[b]:edges[b + 1]] for c in columns)))
            for b in range(buckets) if edges[b] < edges[b + 1]]


def _repeated_anchors(buckets: int, heavy: int):
    """Pass 1, reduce: places of the anchors that occur again, by the document's bucket; heavy grams as rows of kind SINGLE."""

    def run(batches):
        grams, counts, docs, places, known = [], [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                if kind == KNOWN:
                    known.append(unsqueeze(blob.as_py()))
                else:
                    g, c, d, p = unsqueeze(blob.as_py())
                    grams.append(np.cumsum(g, dtype=U64))
                    counts.append(c), docs.append(d), places.append(p)
        out_doc, out_place = [k[0] for k in known], [k[1] for k in known]
        if grams:
            g, c, d, p = map(np.concatenate, (grams, counts, docs, places))
            order = np.argsort(g, kind="stable")
            g, c, d, p = g[order], c[order].astype(np.int64), d[order], p[order]
            head = np.flatnonzero(np.diff(g, prepend=g[0] ^ U64(1)) != 0)
            total, members = np.add.reduceat(c, head), np.diff(head, append=len(g))
            again = np.repeat(total > 1, members) & (c == 1)
            out_doc.append(d[again]), out_place.append(p[again])
            large = np.flatnonzero(total > heavy)
            yield rows_out([(int(min(total[k], 2**31 - 1)), SINGLE, int(g[head[k]].view(np.int64)), b"") for k in large])
        if out_doc:
            yield rows_out(_by_document(PLACES, buckets, np.concatenate(out_doc), np.concatenate(out_place)))

    return run


def _compressed(buckets: int):
    """Texts as rows of kind TEXT by their document's bucket."""

    def run(batches):
        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            raw = [squeezer.compress(memoryview(v.as_buffer())) for v in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_bucket(ids, buckets), pa.int32()), pa.array(np.full(len(ids), TEXT), pa.int32()),
                 pa.array(ids), pa.array(raw, pa.binary())], ["bucket", "kind", "doc", "blob"])

    return run


def meet(texts: DataFrame, found: DataFrame, run: Callable, schema: str, buckets: int) -> DataFrame:
    """Bring each text together with what was found about its document and run ``run`` over them."""
    return (texts.mapInArrow(_compressed(buckets), ROWS).unionByName(found).repartitionById(buckets, "bucket")
            .sortWithinPartitions("kind", "doc").mapInArrow(run, schema))


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[np.ndarray]], Iterator]]:
    """First all blobs of kind PLACES (documents restored), then slices (ids, bytes, offsets) of the texts."""
    blobs: list[list[np.ndarray]] = []

    def unpack():
        opener, size = zstandard.ZstdDecompressor(), 0
        ids, raws = [], []
        for batch in batches:
            for kind, doc, blob in zip(batch.column("kind").to_pylist(), batch.column("doc").to_pylist(), batch.column("blob")):
                if kind == PLACES:
                    doc_steps, *rest = unsqueeze(blob.as_py())
                    blobs.append([np.cumsum(doc_steps), *rest])
                    continue
                ids.append(doc), raws.append(opener.decompress(blob.as_py()))
                size += len(raws[-1])
                if size >= SLICE_BYTES:
                    yield ids, raws
                    ids, raws, size = [], [], 0
        if ids:
            yield ids, raws

    for ids, raws in unpack():
        at = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        yield blobs, (np.array(ids, dtype=np.int64), np.frombuffer(b"".join(raws), np.uint8), at)


def place_keys(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(U64)) + place.astype(U64))


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` numbers, then the same of the next."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def pick(held: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches, one after the other; about a megabyte at a time, as each byte takes a few numbers."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, held.dtype)
    first = at = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, at + (1 << 20), side="right")))
        part = held[stretches(start[first:last], size[first:last])]
        out[at:at + len(part)] = part
        first, at = last, at + len(part)
    return out


def earliest(group: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal ``group`` keys: whether a row is the earliest one (the first of several alike), and whether an earlier one exists."""
    order = np.lexsort((place, doc, *group[::-1]))
    same = np.ones(len(order), bool)
    for g in group:
        s = g[order]
        same[1:] &= s[1:] == s[:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, p = doc[order], place[order]
    later = (d != d[head]) | (p != p[head])
    first, again = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], again[order] = ~same, later
    return first, again


def _segments(shape: Shape, buckets: int, heavy_grams: np.ndarray, engine):
    """Pass 2: segments of the repeated anchors, by bucket."""

    def flush(kept):
        gram, segment, doc, first, windows, lead, offset, held = kept
        one, again = earliest((gram, segment, windows), doc, first)
        rows = _by_document(KNOWN, buckets, doc[again], first[again].astype(np.int64), windows[again].astype(np.int64))
        keep = np.flatnonzero(one)
        if len(keep):
            rows += engine.send(gram[keep], doc[keep], first[keep], windows[keep], lead[keep], offset[keep], np.diff(offset)[keep], held, buckets)
        return rows

    def flush_windows(kept):
        gram, content, doc, place = kept
        one, again = earliest((gram, content), doc, place)
        rows = _by_document(KNOWN, buckets, doc[again], place[again], np.ones(int(again.sum()), np.int64))
        content, gram, doc, place = (x[one] for x in (content, gram, doc, place))
        order = np.argsort(content, kind="stable")
        edges = np.searchsorted(bucket_of(content[order], buckets), np.arange(buckets + 1))
        for b in range(buckets):
            part = order[edges[b]:edges[b + 1]]
            if len(part):
                rows.append((b, SINGLE, 0, squeeze(np.diff(content[part], prepend=U64(0)), gram[part], doc[part], place[part])))
        return rows

    def joined(kept):
        *columns, held = zip(*kept)
        sizes = [np.diff(o) for o in columns[6]]
        offset = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return [*(np.concatenate(c) for c in columns[:6]), offset, np.concatenate(held)]

    def run(batches):
        keys, kept, n, single, m = None, [], 0, [], 0
        for blobs, (ids, held, at) in stream(batches):
            if keys is None:
                keys = np.unique(np.concatenate([place_keys(*b) for b in blobs])) if blobs else np.empty(0, U64)
            if not len(keys):
                continue
            texts = Texts(shape, held, at)
            s, rolling = segments_of(shape, texts)
            doc, base = ids[s.text], texts.at[s.text]
            mine = place_keys(doc, s.anchor - base)
            take = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine)
            wide = np.isin(s.gram[take], heavy_grams)
            rows, large = take[~wide], take[wide]
            if len(rows):
                a, b = texts.start[s.first[rows]], texts.end[s.last[rows] + shape.span - 1]
                kept.append((s.gram[rows], rolling.of(s.first[rows], s.last[rows] + shape.span), doc[rows], s.first[rows] - base[rows],
                             s.last[rows] - s.first[rows] + 1, s.anchor[rows] - s.first[rows],
                             np.concatenate([[0], np.cumsum(b - a)]), pick(held, a, b - a)))
                n += len(rows)
            if len(large):
                size = s.last[large] - s.first[large] + 1
                window, of = stretches(s.first[large], size), np.repeat(large, size)
                single.append((s.gram[of], rolling.of(window, window + shape.span), doc[of], window - base[of]))
                m += len(window)
            if n >= GATHER_SEGMENTS:
                yield rows_out(flush(joined(kept)))
                kept, n = [], 0
            if m >= GATHER_ANCHORS:
                yield rows_out(flush_windows([np.concatenate(c) for c in zip(*single)]))
                single, m = [], 0
        if kept:
            yield rows_out(flush(joined(kept)))
        if single:
            yield rows_out(flush_windows([np.concatenate(c) for c in zip(*single)]))

    return run


def _repeated_windows(shape: Shape, buckets: int, engine):
    """Pass 3: the windows that have an earlier equal one, as runs by document."""

    def run(batches):
        segments, single = [], []
        for batch in batches:
            for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
                if kind == KNOWN:
                    yield rows_out([(bucket, PLACES, 0, blob.as_py())])
                else:
                    (segments if kind == SEGMENTS else single).append(unsqueeze(blob.as_py()))
        doc, place = [], []
        if segments:
            d, p = engine.repeated(segments, shape)
            doc.append(d), place.append(p)
        if single:
            content, gram, d, p = (np.concatenate(c) for c in zip(*((np.cumsum(s[0], dtype=U64), *s[1:]) for s in single)))
            _, again = earliest((content, gram), d, p)
            doc.append(d[again]), place.append(p[again])
        if doc:
            doc, place = np.concatenate(doc), np.concatenate(place).astype(np.int64)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            head = np.flatnonzero((np.diff(doc, prepend=doc[0] - 1 if len(doc) else 0) != 0) | (np.diff(place, prepend=-9) != 1)) if len(doc) else np.empty(0, np.int64)
            if len(head):
                yield rows_out(_by_document(PLACES, buckets, doc[head], place[head], np.diff(head, append=len(doc))))

    return run


def covered(sizes: np.ndarray, at: np.ndarray, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], span: int) -> np.ndarray:
    """A flag for each unit of the texts: whether a repeated window covers it. ``found``: documents in order, first windows, numbers of windows."""
    doc, place, count = found
    lo, hi = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
    rows = stretches(lo, hi - lo)
    base = np.repeat(at[:-1], hi - lo)
    change = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(change, base + place[rows], 1)
    np.add.at(change, base + place[rows] + count[rows] - 1 + span, -1)
    return np.cumsum(change)[:-1] > 0


def windows(docs: DataFrame, id: str, text: str, shape: Shape, engine, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, int]:
    """(texts, rows of repeated windows by document, number of buckets)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    texts = docs.select(id_column(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    repeated = settle(texts.mapInArrow(_anchors(shape, buckets), ROWS).repartitionById(buckets, "bucket")
                      .mapInArrow(_repeated_anchors(buckets, heavy), ROWS))
    grams = repeated.filter(F.col("kind") == SINGLE).orderBy(F.desc("bucket")).limit(MAX_HEAVY).select("doc").toArrow()
    heavy_grams = np.sort(grams.column("doc").to_numpy().view(U64))
    places = repeated.filter(F.col("kind") == PLACES)
    sent = meet(texts, places, _segments(shape, buckets, heavy_grams, engine), ROWS, buckets)
    found = settle(sent.repartitionById(buckets, "bucket").mapInArrow(_repeated_windows(shape, buckets, engine), ROWS))
    return texts, found, buckets


def finish(texts: DataFrame, found: DataFrame, buckets: int, shape: Shape, rows: Callable, schema: str) -> DataFrame:
    """Pass 4: ``rows(ids, Texts, covered)`` gives a batch for each slice of texts."""

    def run(batches):
        whole = None
        for blobs, (ids, held, at) in stream(batches):
            if whole is None:
                if blobs:
                    doc, place, count = (np.concatenate(c) for c in zip(*blobs))
                    order = np.argsort(doc, kind="stable")
                    whole = doc[order], place[order], count[order]
                else:
                    whole = (np.empty(0, np.int64),) * 3
            found_texts = Texts(shape, held, at)
            yield rows(ids, found_texts, covered(found_texts.at, found_texts.at, ids, whole, shape.span), at)

    return meet(texts, found, run, schema, buckets)
