"""Repeated word passages by prefix-partitioned suffix trees.

A suffix is a document from some word on. Those that matter start in a segment whose anchor, a run of ``gram`` words,
occurs more than once (see ``repeats``); the anchor is the prefix that says to which group a suffix goes. Where one such
prefix would make a group too large, the prefix is lengthened to the whole window. A group fits in memory, and its suffix
tree is built level by level: nodes at depth 1, 2, 4, ... words and at the window's length. A suffix that is alone in
its node is a leaf and is not followed further down. The nodes left at the window's length are the repeats; runs of them
are the maximal repeated passages.

Words are runs of bytes outside space and \\t to \\r, compared by 64-bit codes, word by word. Null texts have no words,
texts shorter than a window have no repeats. Repeated rows of one id are one document. A null id is the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import repeats
from cohortloom.llm.common import SLICE_BYTES, give_back_id, id_column, narrow, unused
from cohortloom.llm.repeats import SEGMENTS, Shape, Texts, earliest, pick, squeeze

SPAN, GRAM = 20, 10


def send(gram, doc, first, windows, lead, start, size, held, buckets) -> list[tuple]:
    order = np.argsort(gram, kind="stable")
    edges = np.searchsorted(repeats.bucket_of(gram[order], buckets), np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        part = order[edges[b]:edges[b + 1]]
        if len(part):
            rows.append((b, SEGMENTS, 0, squeeze(doc[part], first[part].astype(np.uint32), narrow(windows[part]),
                                                 size[part].astype(np.uint32), pick(held, start[part], size[part]))))
    return rows


def repeated(segments: list[list[np.ndarray]], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of each window of the segments that has an earlier equal one."""
    doc, first, windows, size, held = (np.concatenate(c) for c in zip(*segments))
    at, words = np.concatenate([[0], np.cumsum(size.astype(np.int64))]), windows.astype(np.int64) + shape.span - 1
    codes, k = [], 0
    while k < len(size):
        last = max(k + 1, int(np.searchsorted(at, at[k] + SLICE_BYTES, side="right")) - 1)
        texts = Texts(shape, held[at[k]:at[last]], at[k:last + 1] - at[k])
        if not np.array_equal(np.diff(texts.at), words[k:last]):
            raise ValueError("a segment doesn't have its words")
        codes.append(texts.codes)
        k = last
    begin = np.concatenate([[0], np.cumsum(words)])
    left = (np.repeat(begin[1:], words) - np.arange(begin[-1])).astype(np.int32)
    node, depth = _nodes(np.concatenate(codes)), 1
    del held, codes
    while depth < shape.span:
        below = min(2 * depth, shape.span)
        inner = np.flatnonzero((left >= below) & (node >= 0))
        inner = inner[node[inner + below - depth] >= 0]
        deeper = np.full(len(node), -1, np.int64)
        deeper[inner] = _nodes(node[inner] * (len(node) + 1) + node[inner + below - depth])
        node, depth = deeper, below
    deep = np.flatnonzero(node >= 0)
    segment = np.repeat(np.arange(len(words)), words)[deep]
    place = first[segment].astype(np.int64) + deep - begin[segment]
    _, again = earliest((node[deep],), doc[segment], place)
    return doc[segment][again], place[again]


def _nodes(keys: np.ndarray) -> np.ndarray:
    """A number for each distinct key that occurs more than once; -1 for the others."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    members = np.diff(head, append=len(s))
    found = np.empty(len(keys), np.int64)
    found[order] = np.repeat(np.where(members > 1, np.arange(len(head)), -1), members)
    return found


class Engine:
    send = staticmethod(send)
    repeated = staticmethod(repeated)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
            heavy: int = repeats.HEAVY) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``n_removed`` and SHA-256 of the words kept, joined by spaces."""
    shape = Shape(True, span, gram)
    texts, found, buckets = repeats.windows(docs, id, text, shape, Engine, heavy)

    def rows(ids, units: Texts, gone, at):
        raw, digest, removed = units.held.tobytes(), [], []
        starts, ends = units.start.tolist(), units.end.tolist()
        for a, b in zip(units.at[:-1].tolist(), units.at[1:].tolist()):
            out = gone[a:b]
            removed.append(int(out.sum()))
            kept = range(a, b) if not removed[-1] else (a + np.flatnonzero(~out)).tolist()
            digest.append(hashlib.sha256(b" ".join([raw[starts[i]:ends[i]] for i in kept])).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(units.at)), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                                          ["id", "n_words", "n_removed", "kept_sha256"])

    return repeats.finish(texts, found, buckets, shape, rows, "id long, n_words long, n_removed long, kept_sha256 string").select(
        give_back_id("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
             heavy: int = repeats.HEAVY) -> DataFrame:
    """The maximal runs of removed words: ``doc_id``, ``start`` and ``n_words``."""
    shape = Shape(True, span, gram)
    texts, found, buckets = repeats.windows(docs, id, text, shape, Engine, heavy)

    def rows(ids, units: Texts, gone, at):
        flag = np.concatenate([[False], gone, [False]])
        edge = np.zeros(len(gone) + 1, bool)
        edge[units.at] = True
        begin = np.flatnonzero(flag[1:-1] & (~flag[:-2] | edge[:-1]))
        end = np.flatnonzero(flag[1:-1] & (~flag[2:] | edge[1:])) + 1
        of = np.searchsorted(units.at, begin, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(begin - units.at[of]), pa.array(end - begin)], ["id", "start", "n_words"])

    return repeats.finish(texts, found, buckets, shape, rows, "id long, start long, n_words long").select(
        give_back_id("id").alias("doc_id"), "start", "n_words").distinct()


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
                    heavy: int = repeats.HEAVY) -> DataFrame:
    """``id``, ``was`` (XXH64 of the text) and ``clean``, the text without its removed words and the space behind each."""
    shape = Shape(True, span, gram)
    texts, found, buckets = repeats.windows(docs, id, text, shape, Engine, heavy)

    def rows(ids, units: Texts, gone, at):
        change = np.zeros(len(units.held) + 1, np.int64)
        of = np.repeat(np.arange(len(ids)), np.diff(units.at))
        if len(gone):
            behind = np.append(units.start[1:], len(units.held))
            np.add.at(change, units.start[gone], 1)
            np.add.at(change, np.minimum(behind, at[1:][of])[gone], -1)
        keep = np.cumsum(change)[:-1] == 0
        cut = np.concatenate([[0], np.cumsum(keep)])[at]
        raw = units.held[keep].tobytes()
        clean = [raw[a:b].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        whole = units.held.tobytes()
        was = np.array([xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(was), pa.array(clean, pa.string())], ["id", "was", "clean"])

    return repeats.finish(texts, found, buckets, shape, rows, "id long, was long, clean string")


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``; rows whose text has none are as they were, and other columns stay, whatever their names."""
    key, was, none, new = unused(docs, "_id", "_was", "_none", "_clean")
    texts = without_repeats(docs, id, text, **options).select(F.col("id").alias(key), F.col("was").alias(was), F.col("clean").alias(new))
    texts = texts.dropDuplicates([key, was])
    # the text itself stays behind: its hash tells which one a row had
    body = F.col(text).cast("string")
    rest = docs.withColumns({key: id_column(id), was: F.xxhash64(F.coalesce(body, F.lit(""))), none: body.isNull()}).drop(text)
    kept = rest.join(texts, [key, was], "left")
    cleaned = F.when(~F.col(none), F.col(new))
    return kept.select(*[(cleaned.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])
