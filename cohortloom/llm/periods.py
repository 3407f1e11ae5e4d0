"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least ``REPEATS`` periods that no neighbouring word extends. All runs of a text are found, scale by scale:

* Periods below ``3 * FIRST`` are read off directly: the words that equal the one q places on, in stretches.
* At the scale t = FIRST, 2 FIRST, 4 FIRST, ... the synchronising set holds the positions i for which the least hash among the t-word
  strings that start at i to i + t is one at an end of this range. Strings with a period of at most t / 3 don't count: they lie in the highly periodic
  regions, which are the runs with small periods that earlier scales have found.
* Membership depends on the 2t words from i on (its context) only, and outside highly periodic regions each range of t positions has a member. So
  in a run with period q from 3t to 6t some member i and i + q are both in the run, with equal contexts. Each pair of members
  at such a distance with equal contexts proposes its distance as a period.
* A proposed period is extended both ways by searching for the longest common extensions of hashes. Every run found is then checked word by
  word; if hashes misled the search, the period is read off the whole text instead. Of the periods of one stretch the smallest counts.

Texts are worked on in blocks of about ``BLOCK_WORDS`` words; an own sign between texts keeps runs inside them. Words are numbered
by a dictionary, so equal numbers are equal words; hashes of strings only propose.

Nulls: a null text has no words; a null id counts as empty in the hash of ``repeated``. Empty texts have no run. A very long text is a block of its own,
with about 200 bytes of memory a word. Repeated rows and ids stand each for itself. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import NO_ID, U64, Rolling, give_back_id, id_column, mix, small_batches, value_buffer

FIRST = 2
REPEATS = 3
BLOCK_WORDS = 200_000
DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    change = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _by_shift(codes: np.ndarray, q: int) -> np.ndarray:
    """(start, end, q) of the stretches with period q and at least REPEATS periods."""
    if len(codes) <= q:
        return np.empty((0, 3), dtype=np.int64)
    start, end = _stretches(codes[q:] == codes[:-q])
    end = end + q
    long = end - start >= REPEATS * q
    return np.stack([start[long], end[long], np.full(int(long.sum()), q)], axis=1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row; ``width`` is a power of two."""
    step = 1
    while step < width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def synchronising_set(hashes: Rolling, n: int, t: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising positions of scale t among n words; ``runs`` has all runs with periods up to t / 3."""
    if n < 2 * t:
        return np.empty(0, dtype=np.int64)
    names = hashes.every(t)
    top = U64(2**64 - 1)
    names = np.minimum(names, top - U64(1))
    flat = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    if len(flat):
        edge = np.bincount(flat[:, 0], minlength=len(names) + 1)[: len(names) + 1] - np.bincount(flat[:, 1] - t + 1, minlength=len(names) + 1)[: len(names) + 1]
        names[np.cumsum(edge)[: len(names)] > 0] = top
    low = _least(names, t)  # of i to i + t - 1
    count = len(names) - t
    least = np.minimum(low[:count], names[t:t + count])
    return np.flatnonzero((least != top) & ((least == names[:count]) | (least == names[t:t + count])))


def _proposals(members: np.ndarray, context: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of pairs of members 3t to 6t - 1 apart with equal contexts."""
    ahead = 1
    while ahead < len(members):
        distance = members[ahead:] - members[:-ahead]
        if not (distance < 6 * t).any():
            break
        use = np.flatnonzero((distance >= 3 * t) & (distance < 6 * t) & (context[ahead:] == context[:-ahead]))
        if len(use):
            yield members[use], distance[use]
        ahead += 1


def _extend(hashes: Rolling, n: int, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch with period q around each position, by binary search over hashes."""
    left, bound = np.zeros(len(at), np.int64), at.copy()
    while (left < bound).any():
        half = (left + bound + 1) // 2
        same = hashes.of(at - half, at) == hashes.of(at - half + q, at + q)
        left, bound = np.where(same, half, left), np.where(same, bound, half - 1)
    right, bound = np.zeros(len(at), np.int64), n - at - q
    while (right < bound).any():
        half = (right + bound + 1) // 2
        same = hashes.of(at, at + half) == hashes.of(at + q, at + q + half)
        right, bound = np.where(same, half, right), np.where(same, bound, half - 1)
    return at - left, at + q + right


def _exact(codes: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the words have period q from start to end and no further."""
    inside = np.array_equal(codes[start:end - q], codes[start + q:end])
    before = start == 0 or codes[start - 1] != codes[start - 1 + q]
    after = end == len(codes) or codes[end] != codes[end - q]
    return bool(inside and before and after)


def all_runs(codes: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, end, period) of all runs of at least REPEATS periods, by start, then period.

    ``codes`` are numbers of words; ``longest`` bounds the length of a run, if known.
    """
    n = len(codes)
    longest = n if longest is None else longest
    found = np.concatenate([_by_shift(codes, q) for q in range(1, 3 * FIRST)] or [np.empty((0, 3), np.int64)])
    found, t = _smallest(found), FIRST
    hashes = Rolling(mix(codes.astype(U64) + U64(1))) if longest >= 9 * t else None
    while 9 * t <= longest:
        members = synchronising_set(hashes, n, t, found)
        members = members[members + 2 * t <= n]
        proposed = list(_proposals(members, hashes.of(members, members + 2 * t), t))
        if proposed:
            at, q = (np.concatenate(c) for c in zip(*proposed))
            start, end = _extend(hashes, n, at, q)
            stretch = np.unique(np.stack([start, end, q], axis=1)[end - start >= REPEATS * q], axis=0)
            good = np.array([_exact(codes, *row) for row in stretch.tolist()], dtype=bool)
            again = [_by_shift(codes, int(p)) for p in np.unique(stretch[~good][:, 2])] if len(stretch) and not good.all() else []
            if len(stretch):
                found = _smallest(np.concatenate([found, stretch[good], *again]))
        t *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of the periods of one stretch only the smallest."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)
    return found[first]


def repeated(n: int, seed: int) -> np.ndarray | None:
    """Which original word stands at each place: for a tenth of the hashes the text is periodic from some place on."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    at = np.arange(n)
    at[first:] = first + (at[first:] - first) % period
    return at


class Text:
    """One text: its words, their numbers after ``repeated``, and later its runs."""

    __slots__ = ("id", "words", "codes", "runs")

    def __init__(self, id: int, raw: bytes, number: dict[bytes, int], plant: bool):
        # bytes.split cuts at space and \t to \r, as the words are defined
        self.id, self.words, self.runs = id, raw.split(), None
        given = number.setdefault
        self.codes = np.array([given(w, len(number)) for w in self.words], dtype=np.int64)
        at = repeated(len(self.words), zlib.crc32(b"" if id == NO_ID else b"%d" % id)) if plant else None
        if at is not None:
            self.codes = self.codes[at]
            self.words = [self.words[i] for i in at.tolist()]

    def kept(self) -> np.ndarray:
        """Which words are left if every run keeps its first period only."""
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(change, self.runs[:, 0] + self.runs[:, 2], 1)
        np.add.at(change, self.runs[:, 1], -1)
        return np.cumsum(change)[:-1] == 0


def _find(texts: list[Text], shortest: int) -> None:
    """Set the runs of the texts, which are searched as one sequence with an own sign after each text."""
    parts, at = [], [0]
    for k, text in enumerate(texts):
        parts += [text.codes, np.array([-2 - k])]
        at.append(at[-1] + len(text.codes) + 1)
    codes = np.concatenate(parts)
    runs = all_runs(codes, max(len(t.codes) for t in texts))
    runs = runs[runs[:, 1] - runs[:, 0] >= shortest]
    where = np.searchsorted(at, runs[:, 0], side="right") - 1
    edges = np.searchsorted(where, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        text.runs = runs[edges[k]:edges[k + 1]] - np.array([at[k], at[k], 0])


def _texts(batches, shortest: int, plant: bool) -> Iterator[list[Text]]:
    """Blocks of texts with their runs."""
    held, size, number = [], 0, {}
    for batch in batches:
        data, at = value_buffer(batch.column("text"))
        whole = data.data
        for k, id in enumerate(batch.column("id").to_pylist()):
            text = Text(id, bytes(whole[at[k]:at[k + 1]]), number, plant)
            held.append(text)
            size += len(text.words) + 1
            if size >= BLOCK_WORDS:
                _find(held, shortest)
                yield held
                held, size, number = [], 0, {}
    if held:
        _find(held, shortest)
        yield held


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(id_column(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 24, plant: bool = False) -> DataFrame:
    """One row per run: ``doc_id``, ``start`` (word number), ``length`` and ``period``. No shuffle."""
    def run(batches):
        for block in _texts(batches, shortest, plant):
            table = np.concatenate([np.column_stack([np.full(len(t.runs), t.id, dtype=np.int64), t.runs]) for t in block])
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2] - table[:, 1]), pa.array(table[:, 3])],
                                             ["id", "start", "length", "period"])

    found = _rows(docs, id, text).mapInArrow(run, "id long, start long, length long, period long")
    return found.select(give_back_id("id").alias("doc_id"), "start", "length", "period")


def collapse(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 24, plant: bool = False) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``n_dropped`` and ``text``, where every run keeps its first period, words joined by a space."""
    def run(batches):
        for block in _texts(batches, shortest, plant):
            rows = []
            for t in block:
                kept = t.kept()
                rows.append((t.id, len(kept), int(len(kept) - kept.sum()), b" ".join([t.words[i] for i in np.flatnonzero(kept).tolist()]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "n_words", "n_dropped", "text"])

    made = _rows(docs, id, text).mapInArrow(run, "id long, n_words long, n_dropped long, text string")
    return made.select(give_back_id("id").alias("doc_id"), "n_words", "n_dropped", "text")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 24, plant: bool = True) -> DataFrame:
    """One row per document row: the number of runs, the one with the greatest exponent (ties: the first, then the smallest period), and
    SHA-256 of the list of runs and of the collapsed text."""
    def run(batches):
        for block in _texts(batches, shortest, plant):
            rows = []
            for t in block:
                found = [(start, end - start, q) for start, end, q in t.runs.tolist()]
                listed = "".join([f"{s},{n},{q}\n" for s, n, q in found]).encode()
                words = t.words
                if found:
                    start, length, q = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                    best = (start, length, q, 1000 * length // q)
                    words = [words[i] for i in np.flatnonzero(t.kept()).tolist()]
                else:
                    best = (None,) * 4
                rows.append((t.id, len(found), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split(" ")[0] for f in DIGESTS.split(", ")])

    return _rows(docs, id, text).mapInArrow(run, DIGESTS).withColumn("doc_id", give_back_id("doc_id"))
