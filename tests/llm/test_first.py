"""Operators against brute force on whole small tables and on edge frames."""

import hashlib
import zlib

import pytest
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer
import xxhash
from hypothesis import given, settings, strategies as st

from cohortloom.llm import bpe, exact, packing, queries, simhash
from cohortloom.llm.components import components

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [(1, "a b c d"), (2, None), (3, ""), (4, "a b c d"), (5, "  \t\n "), (6, "a  b c <|endoftext|> d\n\n e"), (None, "a b c d"),
         (8, "word " * 30000), (9, "word " * 30000), (9, "word " * 30000), (10, "日本語 \x1c x ß"), (11, "x" * 70000)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "clash", 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, value string, print int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


LIBRARY = Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def same_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abtheing's \n\t12.,!é \u0085\x1c", max_size=60))
def test_ids_equal_the_librarys(text):
    library = LIBRARY
    found = bpe.encoder_of(VOCAB).ids(text)
    assert found == same_ids(library, text)
    assert bpe.encoder_of(VOCAB).decode(found).decode() == library.decode(found, skip_special_tokens=False)


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_encode_query_equals_the_library(spark, sf_dir, library, edges, empty):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text")
    for frame in (docs, edges):
        texts = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        want = sorted(str((i, len(ids), digest(",".join(map(str, ids)).encode()),
                           digest(library.decode(ids, skip_special_tokens=False).encode())))
                      for i, t in texts for ids in [same_ids(library, t)])
        assert sorted(str(tuple(r)) for r in bpe.encode_digests(frame).collect()) == want
    assert bpe.encode_digests(empty).count() == 0
    row = bpe.encode(edges.filter("doc_id = 6")).first()
    assert row.ids == same_ids(library, EDGES[5][1]) and row.decoded == EDGES[5][1]


def test_packing_places_every_id_once(spark, sf_dir, library, edges, empty):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text")
    for frame in (docs, edges.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: [*same_ids(library, r.text or ""), 0] for r in frame.select("doc_id", "text").collect()}
        rows = packing.pack(frame).collect()
        seen, packs = {i: 0 for i in ids}, {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
            part = ids[r.doc_id][r.start:r.start + r.length]
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            assert len(part) == r.length and zlib.crc32(raw) == r.ids_crc32
            seen[r.doc_id] += r.length
            packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert seen == {i: len(v) for i, v in ids.items()}
        for parts in packs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
    assert packing.pack(empty).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
@settings(max_examples=60, deadline=None)
def test_patterns_hold_each_length_as_often_as_it_occurs(histogram):
    found, got = packing.patterns(histogram, 64), {}
    for pattern, packs in found:
        assert packs > 0 and sum(n * t for n, t in pattern) <= 64
        for length, times in pattern:
            got[length] = got.get(length, 0) + times * packs
    assert got == histogram


def test_patterns_waste_little():
    found = packing.patterns({n: 1000 for n in range(1, 1025)}, 1024)
    assert sum(n * t * p for pattern, p in found for n, t in pattern) / (1024 * sum(p for _, p in found)) > 0.97


def test_exact_edges(edges, empty):
    rows = exact.duplicates(edges).collect()
    found = {(r.doc_id, r.text_sha256): r for r in rows}
    assert len(rows) == 11  # the repeated row counts once
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (4, 3, False) and by[None].keep_id == 4
    assert by[2].keep_id == 3 and by[2].group_size == 2
    assert by[8].keep_id == 9 and by[9].kept and by[8].group_size == 2
    assert by[11].text_sha256 == digest(b"x" * 70000) and len(found) == 11
    assert exact.duplicates(empty).count() == 0
    assert exact.keep_one(edges.filter("doc_id in (1, 4)")).columns == edges.columns


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_fingerprints_combine(raw, cut):
    import numpy as np

    hasher = exact.Hasher()
    parts = [raw[i:i + cut] for i in range(0, len(raw), cut)]
    values = [(hasher.of(np.frombuffer(p, np.uint8)), len(p)) for p in parts]
    assert exact.combine(values) == (hasher.of(np.frombuffer(raw, np.uint8)), len(raw))


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd")], "doc_id long, text string")
    real = exact.fingerprints
    monkeypatch.setattr(exact, "fingerprints", lambda *a, **b: real(*a, **b).selectExpr("id", "sha", "7L value", "size"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.duplicates(docs).collect()) == [
        (1, 3, 2), (2, 4, 2), (3, 3, 2), (4, 4, 2)]


def brute_print(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.encode().split() if w]
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, sf_dir, edges, empty):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text")
    near = docs.limit(60).selectExpr("doc_id + 1000000 doc_id", "concat(text, ' tail') text")
    for frame in (docs.unionByName(near), edges.select("doc_id", "text").filter("doc_id is not null")):
        prints = {r.doc_id: brute_print(r.text or "") for r in frame.collect()}
        ids = sorted(prints)
        root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2])
        found = simhash.groups(frame).collect()
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{prints[i]:016x}", root[i]) for i in ids}
    assert simhash.groups(empty).count() == 0
    assert simhash.groups(edges).filter("component_id is null").count() == 3


def test_links_are_those_of_all_pairs(spark):
    import random

    random.seed(5)
    base = [random.getrandbits(64) for _ in range(20)]
    prints = {b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (random.randrange(2) << random.randrange(64))
              for b in base for _ in range(25)} | set(base)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {r.node: r.root for r in components(simhash.links(table)).collect()}
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {n: found.get(n, n) for n in signed} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (None, 3), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0xFF), max_size=40))
def test_narrow_texts_have_the_same_pieces(text):
    assert bpe.Pieces.narrow(text) == bpe.Pieces.wide(text)
