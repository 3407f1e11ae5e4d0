"""Spelling variants: words that are one edit apart, grouped under the frequent form, found by a frequency-vector trie.

One edit (a sign inserted, deleted or replaced) moves the vector of letter counts by at most one surplus and one deficit.
So words are put in a trie by successive counts, and a search for a word's variants goes down it with a budget of one
surplus and one deficit; the words of the leaves that it reaches are verified.

* The upper levels count groups of letters (``GROUPS`` of them, letters dealt by their place in the alphabet). A subtree below the
  first ``depth`` of them is one task's group. ``depth`` grows until the largest counted subtree has at most
  ``group_words`` words; one that stays larger with all levels is cut into slices by a hash, each searched with all its
  queries. A word goes as a member to its own subtree and as a query to those that its budget reaches, if they have members.
* Inside a subtree the levels count single letters, the most frequent first. The trie is searched depth first with frontiers of at most
  ``FRONTIER`` queries at a time. A node with few words is a leaf. A leaf with more words than a query has edits
  (anagrams) is asked for the edits, so no pairs of a group are formed.

A word's form is its near word of the largest count if that is at least ``ratio`` times its own. Forms of forms have rising counts, so the chain
to the root has at most log(count) / log(ratio) steps; it is followed by doubling.

Nulls: a null text has no words, a null id counts as empty in the hash. Empty texts and empty tables give no words. Very long texts are read in
stretches. Repeated rows count as often as they occur. Ties go to the word that is smallest by code point. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import NO_ID, SLICE_BYTES, id_column, partitions, small_batches, value_buffer
from cohortloom.runtime import settle

#: A run in UTF-8 with A-Z lower-cased: a to z, and U+00C0 to U+00FF, which are C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
SIGNS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
GROUPS = 8
GROUP_WORDS = 10_000
LEAF = 4
FRONTIER = 200_000
#: Distinct words that a task adds up before it hands them on.
KEPT = 200_000


def runs_of(raw: bytes) -> Counter:
    """How often each run occurs, A-Z lower-cased; a long text is read in stretches that end between runs."""
    found, at, raw = Counter(), 0, raw.lower()
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):
            cut = BREAK.search(raw, end)
            end = cut.start() if cut else len(raw)
        found.update(RUN.findall(raw, at, end))
        at = end
    return found


def worn(run: bytes, seed: int, wear: int) -> bytes:
    """The run, without one sign if ``wear`` divides the hash that goes on from ``seed``."""
    h = zlib.crc32(run, seed)
    if h % wear:
        return run
    signs = run.decode()
    at = h % len(signs)
    return (signs[:at] + signs[at + 1:]).encode()


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 6, fewest: int = 5, wear: int = 199) -> DataFrame:
    """(word, n) of all words with at least ``shortest`` signs and ``fewest`` occurrences; summed in tasks first."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = Counter()

        def flush():
            kept = [(w.decode(), n) for w, n in total.items()]
            kept = [(w, n) for w, n in kept if len(w) >= shortest]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            held, at = value_buffer(batch.column("text"))
            whole = held.data
            for k, doc in enumerate(batch.column("id").to_pylist()):
                seed = zlib.crc32(b":" if doc == NO_ID else b"%d:" % doc)
                for found, n in runs_of(bytes(whole[at[k]:at[k + 1]])).items():
                    if len(found) >= shortest:
                        total[worn(found, seed, wear)] += n
                if len(total) > KEPT:
                    yield flush()
        yield flush()

    rows = docs.select(id_column(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= fewest))


def _places(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the signs of all words in a row, lengths)."""
    signs = np.frombuffer("".join(found).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(signs < 0xC0, signs - ord("a"), signs - 0xC0 + 26), np.array(list(map(len, found)), dtype=np.int64)


def counts_of(found: list[str]) -> np.ndarray:
    """Words x signs matrix of counts."""
    flat, lengths = _places(found)
    row = np.repeat(np.arange(len(found)), lengths)
    return np.bincount(row * len(SIGNS) + flat, minlength=len(found) * len(SIGNS)).reshape(len(found), len(SIGNS))


def keys_of(counts: np.ndarray, depth: int) -> np.ndarray:
    """The subtree of each word: its counts of the first ``depth`` letter groups, a byte each."""
    key = np.zeros(len(counts), dtype=np.int64)
    for g in range(depth):
        key = (key << 8) | np.minimum(counts[:, g::GROUPS].sum(axis=1), 255)
    return key


def _members(depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key = keys_of(counts_of(batch.column("word").to_pylist()), depth)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("word"), batch.column("n")], ["key", "word", "n"])

    return run


def reachable(counts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the subtrees within one surplus and one deficit, each once; of two subtrees that
    reach each other only the one with the larger key is given."""
    own = keys_of(counts, depth)
    groups = np.stack([counts[:, g::GROUPS].sum(axis=1) for g in range(depth)], axis=1)
    rows, keys = [], []
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up == down and up >= 0:
                continue
            moved = groups.copy()
            if up >= 0:
                moved[:, up] += 1
            if down >= 0:
                moved[:, down] -= 1
            use = np.flatnonzero((moved >= 0).all(axis=1))
            key = np.zeros(len(use), dtype=np.int64)
            for g in range(depth):
                key = (key << 8) | np.minimum(moved[use, g], 255)
            ahead = key >= own[use]
            rows.append(use[ahead]), keys.append(key[ahead])
    # counts above 255 share a key, so two moves may lead to one
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)]), axis=1)
    return pairs[0], pairs[1]


def _queries(depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counts = counts_of(batch.column("word").to_pylist())
                rows, keys = reachable(counts, depth)
                same = keys == keys_of(counts, depth)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c).take(pa.array(rows)) for c in ("word", "n")), pa.array(same)],
                                                 ["key", "word", "n", "same"])

    return run


class Trie:
    """Words by successive counts of letters. ``levels[t]`` lists the children of the nodes of level t: sorted
    ``node * 256 + count``, the range of words below each, and its number among the inner nodes of the next level or -1."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts.sum(axis=0), kind="stable")
        counts = np.minimum(counts[:, self.order], 255)
        flat = np.ascontiguousarray(counts.astype(np.uint8))
        self.rows = np.argsort(flat.view(f"S{flat.shape[1]}").ravel(), kind="stable")
        counts = counts[self.rows]
        self.levels = []
        active, node = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
        for t in range(counts.shape[1]):
            key = node * 256 + counts[active, t]
            head = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(np.append(head, len(key)))
            inner = (size > LEAF) if t + 1 < counts.shape[1] else np.zeros(len(size), dtype=bool)
            child = np.where(inner, np.cumsum(inner) - 1, -1)
            low = active[head]
            self.levels.append((key[head], low, low + size, child))
            deeper = np.repeat(inner, size)
            active, node = active[deeper], np.repeat(child, size)[deeper]
            if not len(active):
                break

    def search(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, low, high): the leaves that each query's budget reaches, as ranges of ``rows``."""
        wanted = np.minimum(wanted[:, self.order], 255)
        n = len(wanted)
        stack = [(0, np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.ones(n, dtype=bool))]
        while stack:
            t, query, node, up, down = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack.append((t, query[half:], node[half:], up[half:], down[half:]))
                query, node, up, down = query[:half], node[:half], up[:half], down[:half]
                stack.append((t, query, node, up, down))
                continue
            keys, low, high, child = self.levels[t]
            went = []
            for step, allowed in ((0, None), (1, up), (-1, down)):
                use = np.arange(len(query)) if allowed is None else np.flatnonzero(allowed)
                value = wanted[query[use], t] + step
                if step > 0:
                    value = np.minimum(value, 255)
                inside = value >= 0
                use, value = use[inside], value[inside]
                key = node[use] * 256 + value
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[at] == key
                use, at = use[met], at[met]
                leaf = child[at] < 0
                yield query[use[leaf]], low[at[leaf]], high[at[leaf]]
                use, at = use[~leaf], at[~leaf]
                went.append((query[use], child[at], up[use] & (step <= 0), down[use] & (step >= 0)))
            query, node, up, down = (np.concatenate(c) for c in zip(*went))
            if len(query):
                stack.append((t + 1, query, node, up, down))


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced sign."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def edits(word: str) -> Iterator[str]:
    """All words one edit away, a few more than once."""
    for i in range(len(word) + 1):
        for sign in SIGNS:
            yield word[:i] + sign + word[i:]
            if i < len(word) and sign != word[i]:
                yield word[:i] + sign + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


class Spelled:
    """Words as rows of sign numbers, from the left and from the right, to compare many pairs at a time.

    Words longer than ``WIDE`` have no row and are compared one by one.
    """

    WIDE = 48

    def __init__(self, found: list[str]):
        self.words = found
        flat, self.length = _places(found)
        width = min(self.WIDE, int(self.length.max(initial=0)))
        at = np.cumsum(self.length) - self.length
        self.left, self.right = np.full((2, len(found), width), 255, dtype=np.uint8)
        short = self.length <= width
        row, place = np.repeat(np.arange(len(found)), self.length), np.arange(len(flat)) - np.repeat(at, self.length)
        use = short[row]
        self.left[row[use], place[use]] = flat[use]
        self.right[row[use], self.length[row[use]] - 1 - place[use]] = flat[use]


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs each two rows share at their beginning."""
    width = min(a.shape[1], b.shape[1])
    differ = a[:, :width] != b[:, :width]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def verified(a: Spelled, b: Spelled, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart: what agrees from both sides leaves at most one sign of the longer word."""
    la, lb = a.length[i], b.length[j]
    good, wide = np.abs(la - lb) <= 1, np.maximum(la, lb) > min(a.left.shape[1], b.left.shape[1])
    for k in np.flatnonzero(good & wide):
        good[k] = one_edit(a.words[i[k]], b.words[j[k]])
    use = np.flatnonzero(good & ~wide)
    short, long = np.minimum(la[use], lb[use]), np.maximum(la[use], lb[use])
    head = np.minimum(_agree(a.left[i[use]], b.left[j[use]]), short)
    tail = np.minimum(_agree(a.right[i[use]], b.right[j[use]]), short)
    good[use] = (head + tail >= long - 1) & ((head < short) | (short < long))
    return good


def near_words(members: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(queries, members) that are one edit apart, each pair once."""
    trie, place, asked, found = Trie(counts_of(members)), {}, set(), []
    held, wanted = Spelled(members), Spelled(queries)
    for which, low, high in trie.search(counts_of(queries)):
        size = high - low
        large = size > 2 * len(SIGNS) * (wanted.length[which] + 1)
        for q in set(which[large].tolist()) - asked:
            asked.add(q)
            place = place or {w: k for k, w in enumerate(members)}
            met = {place[w] for w in edits(queries[q]) if w in place}
            found.append((np.full(len(met), q), np.array(sorted(met), dtype=np.int64)))
        which, low, size = which[~large], low[~large], size[~large]
        edges = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + FRONTIER, FRONTIER))
        for a, b in zip(edges, np.append(edges[1:], len(size))):
            n = size[a:b]
            i = np.repeat(which[a:b], n)
            j = trie.rows[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)]
            good = verified(wanted, held, i, j)
            found.append((i[good], j[good]))
    pairs = np.unique(np.concatenate([np.stack(f, axis=1) for f in found] or [np.empty((0, 2), np.int64)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _search(table: pa.Table) -> pa.Table:
    """Near words of one subtree. Queries from other subtrees aren't searched for there, so their pairs go out both ways."""
    member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
    held, asked = table.filter(pa.array(member)), table.filter(pa.array(~member))
    queries, members = np.empty((2, 0), np.int64)
    if held.num_rows and asked.num_rows:
        queries, members = near_words(held.column("word").to_pylist(), asked.column("word").to_pylist())
    at, other = pa.array(queries, pa.int64()), pa.array(members, pa.int64())
    found = pa.table({"word": asked.column("word").take(at), "near": held.column("word").take(other), "near_n": held.column("n").take(other)})
    back = pa.table({"word": found.column("near"), "near": found.column("word"), "near_n": asked.column("n").take(at)})
    return pa.concat_tables([found, back.filter(pa.compute.invert(asked.column("same").take(at)))])


def links(vocabulary: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n): for each word the words one edit away. ``vocabulary`` has distinct words and their counts n."""
    small_batches(vocabulary.sparkSession)
    vocabulary = vocabulary.repartition(partitions(vocabulary.sparkSession), "word").select("word", "n")
    for depth in range(2, GROUPS + 1):
        members = vocabulary.mapInArrow(_members(depth), "key long, word string, n long")
        sizes = settle(members.groupBy("key").agg(F.count("*").alias("size")))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= group_words:
            break
    cut = sizes.select("key", F.ceil(F.col("size") / group_words).cast("int").alias("cuts"))
    asked = vocabulary.mapInArrow(_queries(depth), "key long, word string, n long, same boolean").join(cut, "key")
    asked = asked.select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "word", "n", "same", F.lit(False).alias("member"))
    held = members.join(cut, "key").select("key", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int").alias("cut"), "word", "n",
                                           F.lit(True).alias("same"), F.lit(True).alias("member"))
    return held.unionByName(asked).groupBy("key", "cut").applyInArrow(_search, "word string, near string, near_n long")


def variants(vocabulary: DataFrame, ratio: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    vocabulary = settle(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    best = (links(vocabulary, group_words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")))
    known = vocabulary.join(best, "word", "left").withColumn("top", -F.col("best.less"))
    led = F.col("top") >= F.col("n") * ratio
    rows = settle(known.select("word", F.when(led, F.col("best.near")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("top")).alias("form_n")))
    steps = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    # counts rise by the ratio, so no chain is longer than this
    for _ in range(math.ceil(math.log2(1 + 63 / math.log2(ratio)))):
        steps = settle(steps)
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 6, fewest: int = 5, wear: int = 199, ratio: int = 5,
           group_words: int = GROUP_WORDS) -> DataFrame:
    """The variants of all words of the documents."""
    return variants(words(docs, id, text, shortest, fewest, wear), ratio, group_words)
