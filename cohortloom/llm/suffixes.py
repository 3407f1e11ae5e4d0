"""Repeated byte passages by a distributed merge sort of suffixes that knows common prefixes.

The suffixes sorted are those that start at an anchor which occurs more than once (see ``repeats``), in the order of the
hash of their first ``gram`` bytes and then of their bytes. A task sorts its suffixes and sends, for each range of that
order, a front-coded run: for each suffix how many bytes it shares with the one before, and the rest. A range's runs are
merged by a loser tree. For each run's head the tree knows how much it shares with the suffix put out last, so heads
are compared behind that only, and heads that share different amounts not at all. The merged order comes with the
common prefix of neighbours; these say which suffixes are equal up to any depth.

Two windows are equal if their anchors' suffixes are equal up to the window's end and the bytes before the anchors are
equal back to the window's start; the latter are sorted in the same way. So each window has a pair of classes, and
among windows with one pair all but the earliest are repeats.

Texts are UTF-8 bytes; null texts are empty; texts shorter than a window have no repeats. Repeated rows of one id are one
document. A null id is the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm import repeats
from cohortloom.llm.common import give_back_id, narrow
from cohortloom.llm.repeats import SEGMENTS, Shape, Texts, pick, squeeze, stretches

SPAN, GRAM = 100, 32
HASH = 8


def padded(held: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes: ``size`` bytes from ``start`` in steps of 1 or -1, then zeros."""
    found = np.zeros((len(start), width), np.uint8)
    for first in range(0, len(start), 1 << 13):
        n = size[first:first + (1 << 13)]
        row = np.repeat(np.arange(first, first + len(n)), n)
        nth = stretches(np.zeros(len(n), np.int64), n)
        found[row, nth] = held[start[row] + step * nth]
    return found


def in_order(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of byte strings given as padded rows; a string comes before its continuations."""
    by_size = np.argsort(size, kind="stable")
    whole = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0]
    return by_size[np.argsort(whole[by_size], kind="stable")]


def shared(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before; 0 for the first."""
    found = np.zeros(len(rows), np.int64)
    for first in range(1, len(rows), 1 << 15):
        part = slice(first, min(first + (1 << 15), len(rows)))
        before = slice(part.start - 1, part.stop - 1)
        unlike = rows[part] != rows[before]
        same = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
        found[part] = np.minimum(same, np.minimum(size[part], size[before]))
    return found


def send(gram, doc, first, windows, lead, start, size, held, buckets) -> list[tuple]:
    """Sorted front-coded runs of suffixes, one for each bucket."""
    right = size - lead
    width = HASH + int(right.max())
    rows = np.zeros((len(gram), width), np.uint8)
    rows[:, :HASH] = gram.astype(">u8").view(np.uint8).reshape(-1, HASH)
    rows[:, HASH:] = padded(held, start + lead, right, width - HASH)
    order = in_order(rows, right)
    rows, length = rows[order], (right + HASH)[order]
    lcp = shared(rows, length)
    edges = np.searchsorted(repeats.bucket_of(gram[order], buckets), np.arange(buckets + 1))
    out = []
    for b in range(buckets):
        part = slice(edges[b], edges[b + 1])
        if edges[b] == edges[b + 1]:
            continue
        mine, same = order[part], lcp[part].copy()
        same[0] = 0
        place = np.arange(width)
        rest = rows[part][(place >= same[:, None]) & (place < length[part][:, None])]
        left = pick(held, start[mine], lead[mine])
        out.append((b, SEGMENTS, 0, squeeze(narrow(same), narrow(length[part]), rest, narrow(lead[mine]), left,
                                            narrow(windows[mine]), doc[mine], first[mine].astype(np.uint32))))
    return out


def decoded(same: list[int], length: list[int], rest: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, bytes shared with the one before) of a front-coded run."""
    at, last = 0, b""
    for k, n in zip(same, length):
        last = last[:k] + rest[at:at + n - k]
        at += n - k
        yield last, k


def common(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share, of which ``known`` are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(run, bytes shared with the string put out before) of all strings of sorted runs, in order.

    A loser tree. ``known[r]`` is what run r's head shares with the string that last won at its place in the tree; of two
    heads the one that shares more is less, and only heads that share as much are compared, behind what they share.
    """
    n = len(runs)
    head: list[bytes | None] = []
    known = [0] * n
    for r in runs:
        item = next(r, None)
        head.append(item and item[0])

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); afterwards known[loser] is what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        both = common(x, y, known[a])
        less = both == len(x) if both in (len(x), len(y)) else x[both] < y[both]
        if both == len(x) == len(y):
            less = a < b
        winner, loser = (a, b) if less else (b, a)
        known[loser] = both
        return winner, loser

    losers, level = [0] * max(n, 1), list(range(n))
    # places n..2n-1 are the runs, place k has the loser of places 2k and 2k+1
    up = [0] * n + level
    for k in range(n - 1, 0, -1):
        up[k], losers[k] = play(up[2 * k], up[2 * k + 1])
    winner = up[1] if n > 1 else 0
    while n and head[winner] is not None:
        yield winner, known[winner]
        item = next(runs[winner], None)
        head[winner], known[winner] = item if item is not None else (None, 0)
        k = (winner + n) // 2
        while k:
            winner, losers[k] = play(winner, losers[k])
            k //= 2


def repeated(segments: list[list[np.ndarray]], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(document, first byte) of each window of the segments that has an earlier equal one."""
    same, length, rest, lead, left, windows, doc, first = zip(*segments)
    runs = [decoded(s.tolist(), n.tolist(), r.tobytes()) for s, n, r in zip(same, length, rest)]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in same])])
    nth, order, lcp = begin[:-1].tolist(), [], []
    for run, known in merged(runs):
        order.append(nth[run])
        lcp.append(known)
        nth[run] += 1
    order, lcp = np.array(order, np.int64), np.array(lcp, np.int64)
    if len(order) != begin[-1]:
        raise ValueError("a run was not merged whole")
    lcp[:1] = 0
    lead, windows, doc, first = (np.concatenate(c).astype(np.int64) for c in (lead, windows, doc, first))
    left, left_at = np.concatenate(left), np.concatenate([[0], np.cumsum(lead)])
    # only suffixes whose first gram bytes occur again can have equal windows
    alike = lcp >= HASH + shape.gram
    alike |= np.append(alike[1:], False)
    keep = np.flatnonzero(alike)
    if not len(keep):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, gaps = order[keep], np.where(np.diff(keep, prepend=keep[0] - 1) == 1, lcp[keep], 0)
    lead, windows, doc, first, before = lead[order], windows[order], doc[order], first[order], left_at[1:][order]
    # classes of what stands before the anchors, read backwards
    width = max(1, int(lead.max()))
    back = padded(left, before - 1, lead, width, -1)
    by_back = in_order(back, lead)
    back_shared = shared(back[by_back], lead[by_back])
    when = np.lexsort((first + lead, doc))
    moment = np.empty(len(when), np.int64)
    new = np.concatenate([[True], (np.diff(doc[when]) != 0) | (np.diff((first + lead)[when]) != 0)])
    moment[when] = np.cumsum(new)
    docs, places = [], []
    back_class = np.empty(len(lead), np.int64)
    for n in range(int(lead.max()) + 1):
        mine = when[((lead >= n) & (lead - windows < n))[when]]
        if len(mine) < 2:
            continue
        ahead = np.cumsum(gaps < HASH + shape.span - n)
        back_class[by_back] = np.cumsum(back_shared < n)
        key = ahead[mine] * (len(lead) + 1) + back_class[mine]
        by_key = np.argsort(key, kind="stable")
        s = key[by_key]
        start = np.concatenate([[True], s[1:] != s[:-1]])
        earliest = moment[mine][by_key][np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))]
        again = mine[by_key[moment[mine][by_key] != earliest]]
        docs.append(doc[again])
        places.append(first[again] + lead[again] - n)
    return np.concatenate(docs or [np.empty(0, np.int64)]), np.concatenate(places or [np.empty(0, np.int64)])


class Engine:
    send = staticmethod(send)
    repeated = staticmethod(repeated)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
            heavy: int = repeats.HEAVY) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and SHA-256 of the bytes kept."""
    shape = Shape(False, span, gram)
    texts, found, buckets = repeats.windows(docs, id, text, shape, Engine, heavy)

    def rows(ids, units: Texts, gone, at):
        total = np.concatenate([[0], np.cumsum(gone)])
        flag = np.concatenate([[False], gone])
        begins = gone & ~flag[:-1]
        edge = at[:-1][np.diff(at) > 0]
        begins[edge] |= gone[edge]
        spans = np.concatenate([[0], np.cumsum(begins)])
        raw = units.held[~gone].tobytes()
        kept = at - total[at]
        digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.array(np.diff(spans[at])), pa.array(digest, pa.string())],
                                          ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats.finish(texts, found, buckets, shape, rows, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select(
        give_back_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
