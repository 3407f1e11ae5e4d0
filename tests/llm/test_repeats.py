"""Word and byte repeats against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from cohortloom.llm import queries, suffixes, trees

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts, units_of, span, join):
    """{doc: (units, removed, runs, digest)} for (doc, text) rows with distinct ids."""
    seen, gone, units = set(), {}, {}
    for doc, text in sorted(texts):
        u = units_of((text or "").encode())
        out = [False] * len(u)
        for i in range(len(u) - span + 1):
            key = tuple(u[i:i + span]) if isinstance(u, list) else u[i:i + span]
            if key in seen:
                out[i:i + span] = [True] * span
            seen.add(key)
        units[doc], gone[doc] = u, out
    found = {}
    for doc, u in units.items():
        out = gone[doc]
        kept = join([u[i:i + 1] if isinstance(u, bytes) else u[i] for i in range(len(u)) if not out[i]])
        runs = sum(1 for i in range(len(u)) if out[i] and (i == 0 or not out[i - 1]))
        found[doc] = (len(u), sum(out), runs, hashlib.sha256(kept).hexdigest())
    return found


def planted(n=60, seed=3):
    draw = random.Random(seed)
    words = ["ab", "c", "dé", "e" * 9, "f", "日本"]
    line = lambda k: " ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(k))
    shared = [line(k) for k in (15, 20, 21, 40, 90)]
    rows = []
    for i in range(n):
        parts = [line(draw.randrange(0, 50))]
        for _ in range(draw.randrange(0, 4)):
            parts += [draw.choice(shared), line(draw.randrange(0, 6))]
        rows.append((i * 3, draw.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 500), (1003, "x " * 500), (1004, shared[4]), (1005, "  "), (1006, "\x00" * 300),
             (1007, "a" + "\x00" * 150), (1008, "\x00" * 120 + "b" * 130), (1009, "abcabcabc" * 60), (-5, shared[3])]
    return rows


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    planted_rows = spark.createDataFrame(planted(), "doc_id long, text string").repartition(5)
    docs = queries.documents(spark, sf_dir).select("doc_id", "text").repartition(6)
    return [planted_rows, docs]


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_words_equal_brute_force(frames, heavy):
    for frame in frames:
        want = brute([(r.doc_id, r.text) for r in frame.collect()], WORD.findall, 20, b" ".join)
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in trees.digests(frame, heavy=heavy).collect()}
        assert found == {d: (n, k, h) for d, (n, k, _, h) in want.items()}
        assert sum(k for _, k, _ in found.values()) > 500


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_bytes_equal_brute_force(frames, heavy):
    for frame in frames:
        want = brute([(r.doc_id, r.text) for r in frame.collect()], bytes, 100, b"".join)
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(frame, heavy=heavy).collect()}
        assert found == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert trees.digests(empty).count() == 0 and suffixes.digests(empty).count() == 0 and trees.clean(empty).count() == 0
    long = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(None, long, 1, "k"), (7, long, 2, "k"), (7, long, 2, "k"), (8, None, 3, None)],
                                 "doc_id long, text string, bucket int, id string")
    found = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in trees.digests(rows).collect())
    assert found == [("7", 30, 30), ("7", 30, 30), ("8", 0, 0), ("None", 30, 0)]
    assert sorted((str(r.doc_id), r.start, r.n_words) for r in trees.passages(rows).collect()) == [("7", 0, 30)]
    cleaned = sorted((str(r.doc_id), r.text, r.bucket, r.id) for r in trees.clean(rows).collect())
    assert cleaned == [("7", "", 2, "k"), ("7", "", 2, "k"), ("8", None, 3, None), ("None", long, 1, "k")]
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digests(
        spark.createDataFrame([(None, "z" * 99), (1, "z" * 100), (1, "z" * 100), (2, "z" * 101)], "doc_id long, text string")).collect())
    assert found == [("1", 100, 0, 0), ("1", 100, 0, 0), ("2", 101, 101, 1), ("None", 99, 0, 0)]


def test_clean_leaves_other_text_as_it_was(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(25)) for p in "ab")
    rows = spark.createDataFrame([(1, f"{a}\n\nend "), (2, f"start  of\t{a} \n{b}\n"), (3, "  just \n this ")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in trees.clean(rows).collect()} == {
        1: f"{a}\n\nend ", 2: f"start  of\t{b}\n", 3: "  just \n this "}


@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=7))
@settings(max_examples=300, deadline=None)
def test_merge_gives_order_and_common_prefixes(runs):
    def coded(run):
        last = b""
        for s in sorted(run):
            yield s, suffixes.common(last, s, 0) if last or s == b"" else 0
            last = s

    heads = [iter(sorted(r)) for r in runs]
    out = []
    for run, known in suffixes.merged([coded(r) for r in runs]):
        s = next(heads[run])
        assert known == (suffixes.common(out[-1], s, 0) if out else 0)
        out.append(s)
    assert out == sorted(s for r in runs for s in r)


@pytest.mark.parametrize("span", [1, 100, 255, 256, 300, 2000])
def test_spans_of_any_width(spark, span):
    draw = random.Random(span)
    shared = " ".join(f"w{draw.randrange(10**6)}" for _ in range(2 * span + 200))
    texts = [(1, "a b " + shared), (2, "c " + shared + " d"), (3, "own words only"), (4, shared[: len(shared) // 2] + " z"), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in trees.digests(docs, span=span, gram=max(1, span // 2)).collect()}
    assert got == {d: (n, gone, sha) for d, (n, gone, _, sha) in brute(texts, WORD.findall, span, b" ".join).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, span=span, gram=min(span, suffixes.GRAM)).collect()}
    assert got == brute(texts, bytes, span, b"".join)


def test_stages_keep_columns_with_any_name(spark):
    from cohortloom.llm import exact, ngram, simhash

    line = " ".join(f"word{k}" for k in range(30))
    rows = [(k, f"{line} tail {k}", 77 + k, "w", True, "c", "s", "r", "en") for k in range(4)] + [(9, f"{line} tail 0", 99, "w", True, "c", "s", "r", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _was string, _none boolean, _Clean string, _stays string, _rejected string, lang string")
    cleaned = trees.clean(docs)
    assert cleaned.columns == docs.columns and {r.doc_id: r._id for r in cleaned.collect()} == {0: 77, 1: 78, 2: 79, 3: 80, 9: 99}
    assert {r.doc_id for r in exact.keep_one(docs).collect()} == {1, 2, 3, 9}
    assert simhash.keep_one(docs).columns == docs.columns
    labels = spark.createDataFrame([(k, 1) for k in range(3)], "doc_id long, quality int")
    kept = ngram.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r._rejected for r in kept.collect()} <= {"r"}
