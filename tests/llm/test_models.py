"""Classifiers, archives, vectors and the pipeline against brute force, held-out rows and round trips."""

import hashlib
import inspect
import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import exact, langid, neighbours, ngram, packing, queries, simhash, trees, warc
from cohortloom.llm.common import documents
from cohortloom.llm.symbols import AGAIN, BEGIN, BITS, SYMBOLS, grams, symbols
from cohortloom.runtime import fresh_path


def sequence(text):
    raw = text.encode()
    found, at = symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert at[-1] == len(found)
    return found.tolist()


def test_symbols_mark_repeated_long_words():
    a = sequence("word word word")
    assert a[:4] == sequence("word") and a[4:] == [AGAIN, AGAIN]
    assert AGAIN not in sequence("the the") and AGAIN not in sequence("word\nother word")
    held = np.frombuffer(b"wordword", np.uint8)
    found, at = symbols(held, np.array([0, 4, 8]))
    assert AGAIN not in found.tolist() and at.tolist() == [0, 4, 8]
    first = grams(found, at, 4)[4]
    assert first >> BITS == BEGIN << 12 | BEGIN << 6 | BEGIN


def kneser_ney(trusted, order=4):
    """Probability function from sequences, written from the definition."""
    counts = [dict() for _ in range(order + 1)]
    for seq in trusted:
        padded = [BEGIN] * (order - 1) + seq
        for i in range(order - 1, len(padded)):
            g = tuple(padded[i - order + 1:i + 1])
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discounts = {}
    for k in range(1, order + 1):
        n = [sum(1 for v in counts[k].values() if v == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        discounts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i) if n[i] else 0.5 for i in (1, 2, 3)]
    totals = [dict() for _ in range(order + 1)]
    spare = [dict() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            totals[k][g[:-1]] = totals[k].get(g[:-1], 0) + c
            spare[k][g[:-1]] = spare[k].get(g[:-1], 0) + discounts[k][min(c, 3)]

    def probability(g):
        p = 1 / SYMBOLS
        for k in range(1, order + 1):
            low, h = g[-k:], g[-k:-1]
            if totals[k].get(h):
                c = counts[k].get(low, 0)
                p = (max(c - discounts[k][min(c, 3)], 0) + spare[k][h] * p) / totals[k][h]
        return p

    return probability


def test_perplexity_equals_the_definition(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("n_chars", "key").limit(80).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    found = {r.doc_id: r for r in ngram.score(docs, labels).collect()}
    assert len(found) == len(rows)
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        p = kneser_ney([sequence(r.text) for r in mine if r.doc_id in good])
        for r in mine[:6]:
            seq = sequence(r.text)
            padded = [BEGIN] * 3 + seq
            want = -sum(math.log(p(tuple(padded[i:i + 4]))) for i in range(len(seq))) / len(seq)
            assert found[r.doc_id].n_symbols == len(seq)
            assert math.log(found[r.doc_id].perplexity) == pytest.approx(want, rel=1e-4)
    docs.unpersist()


def test_quality_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    both = {(r.quality, r.kept): r.n for r in ngram.score(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count()
            .withColumnRenamed("count", "n").collect()}
    assert both.get((0, True), 0) <= 0.05 * both[0, False] and both.get((1, False), 0) <= 0.01 * both[1, True]


def test_quality_pools_languages_without_trusted_text(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = documents(spark, sf).select("doc_id", "text", "lang")
    taught = labels.join(known.filter("lang = 'es'"), "doc_id", "left_anti")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    junk = [(10**9 + k, " ".join(word() for _ in range(100)), (None, "zz")[k % 2]) for k in range(20)]
    docs = known.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))).unionByName(spark.createDataFrame(junk, known.schema))
    found = ngram.score(docs, taught).cache()
    assert found.count() == docs.count() and found.filter("lang in ('und', 'zz') and threshold is null").count() == 0
    kept = {r.doc_id for r in found.filter("kept").collect()}
    assert not kept & {i for i, _, _ in junk}
    good = {r.doc_id for r in labels.join(known.filter("lang = 'es'"), "doc_id").filter("quality = 1").collect()}
    assert len(good) > 20 and good <= kept
    # the languages that have trusted text are scored as without the others
    alone = ngram.score(docs.filter("lang in ('de', 'en', 'fr')"), taught)
    assert {(r.doc_id, r.kept) for r in alone.collect()} == {(r.doc_id, r.kept) for r in found.filter("lang in ('de', 'en', 'fr')").collect()}
    found.unpersist()


def test_small_languages_keep_their_trusted_text():
    share = ngram.shares({0: 1_000_000, 1: 40, 2: 300, 3: 50_000}, 1000)
    taken = {c: share[c] * n for c, n in {0: 1_000_000, 1: 40, 2: 300, 3: 50_000}.items()}
    assert share[1] == 1.0 and share[2] == 1.0 and taken[0] == pytest.approx(330) and taken[3] == pytest.approx(330)
    assert ngram.shares({0: 10, 1: 5}, 100) == {0: 1.0, 1: 1.0} and ngram.shares({}, 5) == {}


def test_all_trusted_documents_train_the_models(spark, sf_dir, monkeypatch):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    labels = labels.join(docs.filter("lang is null"), "doc_id", "left_anti")

    def found():
        return {r.doc_id: (r.lang, r.n_symbols, r.perplexity, r.threshold, r.kept) for r in ngram.score(docs, labels).collect()}

    monkeypatch.setattr(ngram, "shares", lambda sizes, bound: pytest.fail("the models are trained on a sample"))
    few = found()
    assert len(few) == docs.count() and any(r[0] == "und" and r[3] for r in few.values())
    # more ids than are broadcast: the same by a shuffle, also with counts added up often
    monkeypatch.setattr(ngram, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram, "PARTIAL_COUNTS", 1)
    for key, row in found().items():
        assert row[:2] == few[key][:2] and row[2:] == pytest.approx(few[key][2:], rel=1e-6, nan_ok=True)


def test_quality_leaves_no_trusted_text_out_and_no_language_unjudged(spark):
    assert "max_trusted" not in inspect.signature(ngram.score).parameters
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk"]) for _ in range(60))
    junk = lambda: "".join(rng.choice(string.ascii_lowercase + " ") for _ in range(300))
    rows = [(k, line(), "en") for k in range(30)] + [(100, "", "fr"), (101, None, "fr"), (102, line(), "fr"), *[(110 + k, junk(), "fr") for k in range(5)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in [*range(30), 100, 101]], "doc_id long, quality int")
    found = {r.doc_id: r for r in ngram.score(docs, labels).collect()}
    # the good documents of fr have no text, so the pooled model judges it
    assert all(found[k].threshold and not found[k].kept for k in range(110, 115))
    assert all(found[k].kept for k in [*range(30), 100, 101, 102])


def test_quality_thresholds_by_brute_force(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [r for r in ngram.score(docs, labels).collect() if r.n_symbols]
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        mean = {r.doc_id: math.log(r.perplexity) for r in mine}
        trusted = [r for r in mine if r.doc_id in good]
        if not trusted:
            continue

        def least(values, share):
            values = sorted(round(v * ngram.SCALE) for v in values)
            return values[math.ceil(share * len(values)) - 1] / ngram.SCALE

        median = least([mean[r.doc_id] for r in trusted], 0.5)
        drawn = {r.doc_id: (mean[r.doc_id] * r.n_symbols + ngram.PRIOR * median) / (r.n_symbols + ngram.PRIOR) for r in mine}
        limit = least([drawn[r.doc_id] for r in trusted], 0.999) * 1.05
        for r in mine:
            assert math.log(r.threshold) == pytest.approx(limit, abs=2 / ngram.SCALE)
            if abs(drawn[r.doc_id] - limit) > 2 / ngram.SCALE:
                assert r.kept == (drawn[r.doc_id] <= limit)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 5), (2, "", None, 6), (None, "some words here", "en", 7), (3, "a word " * 9000, "xx", 8), (3, "again", "en", 9)],
                                 "doc_id long, text string, lang string, total int")
    labels = spark.createDataFrame([(3, 1), (None, 1), (9, 0), (3, None)], "doc_id long, quality int")
    found = ngram.score(docs, labels).collect()
    assert len(found) == 5 and all(r.kept for r in found if not r.n_symbols)
    none = ngram.score(docs, labels.limit(0)).collect()
    assert len(none) == 5 and all(r.kept for r in none)
    assert ngram.score(docs.limit(0), labels).count() == 0 and ngram.score(docs.limit(0), labels).columns == ngram.score(docs, labels).columns
    assert ngram.keep_good(docs, labels).columns == docs.columns


def test_language_of_held_out_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(found) > 100 and (found.lang_pred == found.lang).mean() > 0.97


def test_language_edges(spark):
    rows = [(i, f"the quick word number {i} here", "en", 1) for i in range(40)] + [(100 + i, f"ein schönes wort über {i}", "de", 1) for i in range(40)]
    rows += [(None, "the quick", "en", 1), (500, None, "en", 1), (501, " 12 !", "de", 1), (502, "", None, 1), (503, "the quick word " * 20000, None, 1), (503, "x", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, letters int")
    found = langid.predict(docs, langid.fit(docs)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and {by[i].lang_pred for i in (500, 501, 502)} == {"und"} and by[500].score == 0
    assert all(0 <= r.score <= 1 for r in found) and all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(unlabelled, langid.fit(unlabelled)).collect()} == {"und"}


def test_archive_round_trip(spark, sf_dir):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a.example/x", big, 0), (2, "http://b.example", big, 0), (3, None, big, 0), (4, "http://a.example/x", None, 0), (5, "bad\nurl ☃", "", 0),
            (6, "http://A.example:8080/Q?b#f", "small", 0), (7, "http://a.example/", "small", 0), (None, "http://n.example", big, 0), (8, "u" * 3000, "y" * 300000, 0),
            (6, "http://A.example:8080/Q?b#f", "small", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, of int")
    whole = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = warc.write(pages, fresh_path(spark, "t"))
    found = warc.lookup(archive, pages).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 10  # the repeated row was archived twice and is asked for once
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert by[i].record_type == ("revisit" if i in (1, 2, None) else "response") and by[i].refers_to == (3 if i in (1, 2, None) else None)
        assert by[i].payload == (None if by[i].record_type == "revisit" else raw)
    some = warc.lookup(archive, pages.filter("page_id in (2, 8)")).collect()
    assert sorted(r.page_id for r in some) == [2, 8]
    assert warc.lookup(archive, spark.createDataFrame([(99, "http://zz.example")], "page_id long, url string")).count() == 0
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    back = warc.round_trip(spark, whole).select("page_id", "payload").collect()
    assert {(r.page_id, bytes(r.payload)) for r in back} == {(r.page_id, r.html.encode()) for r in whole.collect()}


def test_index_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(i, f"http://h{i % 7}.example/{i % 5}", f"page {i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.round_trip(spark, pages).collect()} == {(i, h) for i, _, h in rows}


def brute_links(vectors, threshold=0.9):
    ids = [i for i, v in vectors]
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(v) if good else None for (_, v), good in zip(vectors, ok)]
    links = {i: 0 for i in ids}
    root = {i: i for i in ids}
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, b in pairs:
        links[ids[a]] += 1
        links[ids[b]] += 1
    while True:
        before = dict(root)
        for a, b in pairs:
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
        if root == before:
            return links, root


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    vectors = [(i, draw.normal(size=16).tolist()) for i in range(300)]
    centre = draw.normal(size=16)
    vectors += [(1000 + i, (centre + draw.normal(0, 0.12, 16)).tolist()) for i in range(400)]  # more than one block
    vectors += [(2000 + i, vectors[i][1]) for i in range(30)] + [(3000 + i, (2 * np.array(vectors[40 + i][1]) + draw.normal(0, 0.2, 16)).tolist()) for i in range(60)]
    vectors += [(4000, None), (4001, [0.0] * 16), (4002, [1.0, None] + [0.0] * 14), (4003, [float("nan")] * 16), (4004, [float("inf")] + [1.0] * 15), (4005, [])]
    vectors += [(4006, [1.0, 0.0]), (4007, [2.0, 0.1]), (4008, [5e-324] * 16)]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, v int")
    links, root = brute_links(vectors)
    rows = neighbours.near_duplicates(table).collect()
    found = {r.vec_id: r.n_links for r in rows}
    assert len(rows) == len(vectors) and all(found[i] <= links[i] for i in links)
    assert sum(found.values()) >= 0.97 * sum(links.values())
    assert sum(r.component_id == root[r.vec_id] for r in rows) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


def audited_vertices(spark, groups, alone, seed=3):
    """Vertices of random directions: groups of near copies of the given sizes, and vectors alone; and their true links."""
    rng, rows, links = np.random.default_rng(seed), [], []
    for size in [*groups, *[1] * alone]:
        centre = rng.normal(size=48)
        for _ in range(size):
            rows.append((len(rows), 1, bytearray((centre + rng.normal(size=48) * 0.01).tobytes())))
            links.append(size - 1)
    return spark.createDataFrame(rows, "v long, copies long, full binary"), links


def test_audit_goes_on_until_links_are_seen(spark):
    vertices, _ = audited_vertices(spark, [2], 1500)
    none = spark.createDataFrame([], "v long, n long, plain long")
    assert neighbours.audit(vertices, none, 0.9) == 0
    assert neighbours.audit(vertices, spark.createDataFrame([(0, 1, 1), (1, 1, 1)], none.schema), 0.9) == 1


def test_audit_of_a_large_group_does_not_hide_missed_pairs(spark):
    vertices, links = audited_vertices(spark, [500, *[2] * 150], 100)
    counts = spark.createDataFrame([(v, n, n) for v, n in enumerate(links) if n > 1], "v long, n long, plain long")
    assert neighbours.audit(vertices, counts, 0.9) < 0.1


def test_low_recall_stops_the_job(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "audit", lambda *a, **b: 0.5)
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(table, attempts=1)


def test_tables_grow_with_bits():
    shared = 1 - math.acos(0.9) / math.pi
    for bits in (1, 11, 16, 22, 30):
        assert (1 - shared ** bits) ** neighbours.tables_for(bits, 0.9) <= 0.0051


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    from tests.llm.test_first import brute_print, roots
    from tests.llm.test_repeats import WORD

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir)
    good = {r.doc_id for r in ngram.score(docs, labels).filter("kept").collect()}
    left = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(left):
        last[left[i].text] = i
    left = {i: left[i] for i in last.values()}
    prints = {i: brute_print(r.text) for i, r in left.items()}
    ids = sorted(left)
    root = roots(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2])
    left = {i: left[i].text for i in ids if root[i] == i}
    seen, tokens = set(), {}
    encoder = packing.encoder_of(packing.default_vocabulary())
    for i in sorted(left):
        raw = left[i].encode()
        spans = [m.span() for m in WORD.finditer(raw)]
        words, gone = [raw[a:b] for a, b in spans], set()
        for k in range(len(words) - 19):
            key = tuple(words[k:k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        cuts = [(spans[k][0], spans[k + 1][0] if k + 1 < len(spans) else len(raw)) for k in sorted(gone)]
        clean, at = b"", 0
        for a, b in cuts:
            clean += raw[at:a]
            at = b
        tokens[i] = len(encoder.ids((clean + raw[at:]).decode())) + 1
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == tokens
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, sf_dir, stage):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "a b c", "en", "s", 5, "x"), (2, "", "en", "s", 0, None), (2, "", "en", "s", 0, None),
                                  (3, "long word " * 20000, "en", "s", 1, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, id string")
    found = stage(spark, docs, sf_dir)
    assert found.count() > 0
    if stage is not corpus_pipeline.pack:
        assert found.columns == docs.columns and {r.doc_id for r in found.collect()} <= {None, 1, 2, 3}
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_every_contract_query_is_registered():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in queries.ALL)] == list(range(1, 11)) and "pipeline" in queries.ALL
    assert exact and simhash and trees
