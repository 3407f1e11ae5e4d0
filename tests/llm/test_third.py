"""Mixing, spelling variants and periodic runs against brute force, on hand-made and whole small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from cohortloom.llm import mixing, periods, queries, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "place int, start string, piece int, block string, uses int, n int, key string, cut int, id string, runs int, target string"
CLASH = (1, "x", 2, "y", 3, 4, "k", 5, "i", 6, "t")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# ---- mixing ------------------------------------------------------------------------------
def signed(value):
    return value - (1 << 64) if value >> 63 else value


def long_hash(*values):
    """The engine's hash of long and int columns, one seeding the next."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = struct.pack("<q", v[1]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return signed(h)


def image(x, n, *key, seed=mixing.SEED):
    for r in range(mixing.ROUNDS):
        partner = (long_hash(seed, *key, ("long", r)) % n - x) % n
        if long_hash(seed + 1, *key, ("long", r), ("long", max(x, partner))) & 1:
            x = partner
    return x


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(names)}
    whole, target, stopped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in stopped]
        left = whole - sum(most * sizes[s] for s in stopped)
        target = {s: Fraction(most * sizes[s]) for s in stopped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return names, target
        stopped |= above


def expected_mix(docs, block_words, shard_slots, most=3):
    """{(doc_id, text): words taken} by plain loops."""
    rows = [(i, t, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    sizes = Counter()
    for _, _, s, n in rows:
        sizes[s] += n
    names, target = expected_targets(sizes)
    blocks = {s: -(-sizes[s] // block_words) for s in names}
    slots = {s: min(most * blocks[s], math.floor(float(target[s]) / (sizes[s] / blocks[s]) + 0.5)) if sizes[s] else 0 for s in names}
    whole, tickets, drawn = sum(slots.values()), 0, Counter()
    for k, s in enumerate(names):
        for t in range(slots[s]):
            drawn[image(tickets + t, whole, ("long", -1)) // shard_slots, k] += 1
        tickets += slots[s]
    uses, first = Counter(), Counter()
    for (shard, k), n in sorted(drawn.items()):
        for at in range(first[k], first[k] + n):
            turn, index = divmod(at, blocks[names[k]])
            uses[k, image(index, blocks[names[k]], ("long", k), ("long", turn))] += 1
        first[k] += n
    assert all(first[k] == slots[s] for k, s in enumerate(names))
    result = Counter()
    pieces = max(1, int(len(rows) ** 0.5))
    for k, s in enumerate(names):
        at = 0
        mine = [(long_hash(mixing.SEED, None if i is None else ("long", i), t), i, t, n) for i, t, src, n in rows if src == s]
        for _, i, t, n in sorted(mine, key=lambda r: (r[0] % pieces, r[0])):
            for w in range(at, at + n):
                result[i, t] += uses[k, w // block_words]
            at += n
    return result, sizes, target


MIXED = ([(i, "w " * (7 * i % 90) + "end", "abc"[i % 3]) for i in range(60)]
         + [(100, None, "a"), (101, "", "b"), (102, " \t\r\n\x0b\x0c", None), (None, "no id at all", None), (103, "é x  日本 \x1cz", "Z"),
            (104, "word " * 3000, "big"), (105, "tiny", "ä"), (106, "same text here", "b"), (106, "same text here", "b"), (107, None, "nothing")])


@pytest.mark.parametrize("block_words, shard_slots", [(1, 50), (8, 16), (64, 8192)])
def test_mix_equals_brute_force(spark, block_words, shard_slots):
    docs = spark.createDataFrame([(*r, *CLASH) for r in MIXED], f"doc_id long, text string, source string, {CLASHES}")
    got = mixing.taken(docs, block_words=block_words, shard_slots=shard_slots).collect()
    want, sizes, target = expected_mix(MIXED, block_words, shard_slots)
    assert len(got) == len(MIXED)
    found = Counter()
    for r in got:
        found[r.doc_id] += r.taken
        assert r.size <= r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]))
        assert 0 <= r.taken <= 3 * r.size
    by_id = Counter()
    for (i, _), n in want.items():
        by_id[i] += n
    assert +found == +by_id


def test_mix_comes_near_its_targets_and_agrees_with_its_texts(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    rows = queries.op11_mixing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(queries.op11_mixing(spark, sf_dir).collect())
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    reached, target = Counter(), {}
    for r in rows:
        reached[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(reached[s] - t) <= 64 for s, t in target.items())
    mixed = mixing.mix(docs, shard_slots=100).collect()
    words = Counter()
    for r in mixed:
        assert len(WORD.findall(r.text)) == r.words <= 64
        words[r.source] += r.words
    assert words == reached
    assert max(Counter(r.shard for r in mixed).values()) == 100


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_bijections(spark, n):
    from pyspark.sql import functions as F

    made = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("y")).collect()
    assert sorted(r.y for r in made) == list(range(n))
    assert [r.y for r in made] == [image(x, n, ("long", 3)) for x in range(n)]


def test_mix_of_nothing(spark, empty):
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in mixing.taken(none).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


# ---- spelling variants ---------------------------------------------------------------------
def expected_variants(docs, shortest=6, fewest=5, wear=199, ratio=5):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if h % wear == 0 else run] += 1
    n = {w: c for w, c in total.items() if len(w) >= shortest and c >= fewest}
    near = {w: {x for x in n if spelling.one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    found = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return found


@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit_is_a_distance_of_one(a, b):
    made = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abé"} | {a[:i] + a[i + 1:] for i in range(len(a))}
    made |= {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in "abé"}
    assert spelling.one_edit(a, b) == (b in made and a != b)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcÿ÷z", min_size=1, max_size=7), min_size=1, max_size=60))
def test_trie_finds_every_near_word(words):
    words = sorted(words)
    q, m = spelling.near_words(words, words)
    assert set(zip(q, m)) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if spelling.one_edit(a, b)}
    assert len(q) == len(set(zip(q, m)))


def test_anagrams_are_asked_for_edits(monkeypatch):
    from itertools import permutations

    words = sorted({"".join(p) for p in permutations("abcdeef")})[:2500]
    asked = ["abcdeff", "xabcdeef", "abcdee", "abcdeef", "fedcbae"]
    q, m = spelling.near_words(words, asked)
    assert set(zip(q, m)) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if spelling.one_edit(a, b)}


@pytest.mark.parametrize("group_words", [1, 30, 50_000])
def test_variants_equal_brute_force(spark, group_words):
    base = ["letters", "lettres", "Letter's", "letterss", "lettersss", "lettérs", "LETTERS", "ÀÀÀÀÀÀÀ", "àÀÀÀÀÀÀ", "aaaaaaaaa", "aaaaaaaaaa", "x" * 400, "x" * 401,
            "x" * 399 + "y", "straße", "strasse", "strase", "stra÷e", "ab" * 40, "ba" * 40, "short"]
    docs = [(k, " ".join(w for j, w in enumerate(base) for _ in range((j * 5 + k) % 7))) for k in range(40)]
    docs += [(None, "letters letters"), (50, None), (51, ""), (52, "12 ;;"), (53, "letters-" * 60_000), (53, "letters-" * 60_000), (54, "lettre " * 300)]
    frame = spark.createDataFrame([(*r, *CLASH) for r in docs], f"doc_id long, text string, {CLASHES}")
    got = {tuple(r) for r in spelling.groups(frame, group_words=group_words).collect()}
    assert got == expected_variants(docs)
    # chains: a root is reached over several forms
    chained = [(k, " ".join(["chains"] * 4000 + ["chainss"] * 500 + ["chainsss"] * 60 + ["chainssss"] * 6)) for k in range(2)]
    found = {r.word: r for r in spelling.groups(spark.createDataFrame(chained, "doc_id long, text string"), wear=10**9).collect()}
    assert found["chainssss"].form == "chainsss" and found["chainssss"].root == "chains"


def test_variants_of_nothing(spark, empty):
    assert spelling.groups(empty).count() == 0


# ---- periodic runs --------------------------------------------------------------------------
def expected_runs(codes):
    n, found = len(codes), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if codes[i] == codes[i + q]:
                start = i
                while i + q < n and codes[i] == codes[i + q]:
                    i += 1
                if i + q - start >= 3 * q:
                    found.setdefault((start, i + q), q)
            else:
                i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


@st.composite
def sequences(draw):
    kind = draw(st.integers(0, 3))
    if kind == 0:
        return draw(st.lists(st.integers(0, 1), max_size=150))
    if kind == 1:  # stretches of repeats, whose units may be repeats themselves
        made = []
        for unit, times, extra in draw(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 7), st.integers(0, 9)), max_size=4)):
            made += unit * times + unit[:extra]
        return made
    if kind == 2:
        unit = [0] * draw(st.integers(1, 50)) + [1] + [0] * draw(st.integers(0, 3))
        return unit * draw(st.integers(3, 5)) + [2] + unit
    a, b = [0], [0, 1]
    while len(b) < 120:
        a, b = b, b + a
    return b * draw(st.integers(1, 4))


@settings(max_examples=300, deadline=None)
@given(sequences())
def test_all_runs_are_found(codes):
    assert [tuple(r) for r in periods.all_runs(np.array(codes, dtype=np.int64)).tolist()] == expected_runs(codes)


def test_misleading_hashes_don_t_change_runs(monkeypatch):
    monkeypatch.setattr(periods, "mix", lambda x: x & np.uint64(1))  # half of the words look alike
    codes = ([0, 1, 2, 3, 4, 5, 6, 7] * 5 + [9] + [0, 3, 2, 1, 4, 5, 6, 7] * 4) * 3
    assert [tuple(r) for r in periods.all_runs(np.array(codes)).tolist()] == expected_runs(codes)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_digest(i, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = [r for r in expected_runs([number[w] for w in words]) if r[1] - r[0] >= 24]
    dropped = {k for s, e, q in runs for k in range(s + q, e)}
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(runs), *shown, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_period_digests_equal_brute_force(spark, empty):
    texts = [(k, "a b c d " * (k % 9) + f"x{k} " + "la " * (k % 30) + "u v " * (k % 17)) for k in range(60)]
    texts += [(None, "q " * 30), (70, None), (71, ""), (72, " \t\n"), (73, "one two\x1cthree four " * 15), (74, "wide " * 2500), (74, "wide " * 2500),
              (75, " ".join(str(j % 700) for j in range(2400))), (76, ("a b " * 20 + "c ") * 20), (77, "long" * 50_000)]
    frame = spark.createDataFrame([(*r, *CLASH) for r in texts], f"doc_id long, text string, {CLASHES}")
    got = sorted((tuple(r) for r in periods.digests(frame).collect()), key=repr)
    assert got == sorted((expected_digest(i, t) for i, t in texts), key=repr)
    assert periods.digests(empty).count() == periods.runs(empty).count() == periods.collapse(empty).count() == 0
    # the operator's own results: runs as rows, and texts with each run's first period
    found = sorted(tuple(r) for r in periods.runs(frame.filter("doc_id = 76")).collect())
    number = {"a": 0, "b": 1, "c": 2}
    assert found == sorted((76, s, e - s, q) for s, e, q in expected_runs([number[w] for w in texts[-2][1].split()]) if e - s >= 24)
    short = {r.doc_id: r for r in periods.collapse(frame.filter("doc_id in (71, 73, 75)")).collect()}
    assert short[71].text == "" and short[71].n_words == 0 and short[75].n_dropped == 1700
    assert short[73].text == "one two\x1cthree four"


def test_whole_table_of_periods_equals_brute_force(spark, sf_dir):
    short = queries.documents(spark, sf_dir).filter("length(text) < 4000").select("doc_id", "text")
    want = {expected_digest(r.doc_id, r.text) for r in short.collect()}
    ids = {w[0] for w in want}
    assert {tuple(r) for r in queries.op13_periods(spark, sf_dir).collect() if r.doc_id in ids} == want
