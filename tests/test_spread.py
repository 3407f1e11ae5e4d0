"""Ranks, samples, folds and quantiles against plain Python on skewed groups."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evaluate as ev
from cohortloom.operators import ranking as rk
from cohortloom.operators import spread
from cohortloom.operators import stats as st
from cohortloom.operators.aggregates import box_summary
from cohortloom.operators.figdata import hemisphere_vectors, ordered_probabilities
from cohortloom.operators.topics import pattern_frame


def key(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Class 'hot' holds most rows, 'small' six, 'one' a single row."""
    data = [(i, "hot" if i >= 7 else "small" if i else "one") for i in range(3000)] + [(9000, None)]
    return spark.createDataFrame(data, "id long, dx string").repartition(4).cache()


@pytest.fixture(params=[500_000, 20], ids=["one-piece", "many-pieces"])
def piece_rows(request, monkeypatch):
    """Small groups in one piece, and the hot class cut into many."""
    monkeypatch.setattr(spread, "PIECE_ROWS", request.param)


def test_cap_keeps_small_classes_whole(skewed, piece_rows):
    got = {}
    for r in rk.cap_per_class(skewed, "dx", ["id"], 100, {"one": 5}).collect():
        got.setdefault(r["dx"], set()).add(r["id"])
    assert got["small"] == set(range(1, 7)) and got["one"] == {0}
    assert got["hot"] == set(sorted(range(7, 3000), key=key)[:100])


def test_sample_is_exact_and_bounded(skewed, piece_rows):
    ids = [*range(3000), 9000]
    assert {r["id"] for r in rk.sample_rows(skewed, ["id"], 250).collect()} == set(sorted(ids, key=key)[:250])
    assert rk.sample_rows(skewed, ["id"], 10_000).count() == 3001


def test_folds_are_balanced_and_total(skewed, piece_rows):
    got = rk.stratified_folds(skewed, "dx", ["id"], 5).collect()
    assert len(got) == 3000
    order = sorted(range(7, 3000), key=key)
    assert {r["id"]: r["fold"] for r in got if r["dx"] == "hot"} == {i: n % 5 for n, i in enumerate(order)}


def test_holdout_share(skewed, piece_rows):
    got = rk.stratified_holdout(skewed, "dx", ["id"], 0.2).filter("is_test").groupBy("dx").count().collect()
    assert {r["dx"]: r["count"] for r in got} == {"hot": round(0.2 * 2993), "small": 1}


def test_positions_follow_the_total_order(spark):
    data = [(i, "g" if i % 3 else None, float(i % 4) if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(data, "id int, g string, v double").repartition(5)
    got = spread.sorted_position(df, [F.col("v").desc_nulls_last(), F.col("id")], ["g"]).collect()
    for group in ("g", None):
        want = sorted((d for d in data if d[1] == group), key=lambda d: (d[2] is None, -(d[2] or 0), d[0]))
        have = {r["position"]: r["id"] for r in got if r["g"] == group}
        assert have == {n + 1: d[0] for n, d in enumerate(want)}


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact_with_ties(spark, accuracy):
    rng = np.random.default_rng(1)
    data = [("a", float(np.round(v, 2))) for v in rng.normal(size=4001)] + [("b", 1.0)] * 1500
    data += [("b", float(v)) for v in rng.uniform(0, 2, 777)] + [("c", 3.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    got = spread.exact_quantiles(df, ["g"], "v", (0.25, 0.5, 0.75), accuracy).collect()
    for r in got:
        values = np.array([v for g, v in data if g == r["g"] and v is not None and v == v])
        assert r["n"] == len(values)
        assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), abs=1e-12)
    assert {r["g"] for r in got} == {"a", "b", "c"}


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = box_summary(df, "g", "v").first()
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"], r["median"]) == (1.0, 5.0, 2, 3.0)


def test_rank_ties_go_to_first_column(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.7)], "id int, a double, b double, c double")
    got = rk.ranked_long(df, ["id"], ["a", "b", "c"]).orderBy("Rank").collect()
    assert [(r["Rank"], r["Topic"], r["Weight"]) for r in got] == [(1, "c", 0.7), (2, "a", 0.5), (3, "b", 0.5)]


def test_order_guards(spark):
    df = spark.createDataFrame([(1, "A", 0.4, 0.6)], "id int, dx string, `P(A)` double, `P(B)` double")
    with pytest.raises(ValueError):
        ordered_probabilities(df, "dx", ["id"], ["A"])
    with pytest.raises(ValueError):
        ordered_probabilities(df.withColumn("dx", F.lit("Z")), "dx", ["id"], ["A", "B"])
    with pytest.raises(ValueError):
        hemisphere_vectors(pattern_frame(spark, [[1.0, 2.0]], ["a", "b"]), "topic", 62)


def test_report_zero_division_is_zero(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A")], "o string, p string")
    got = {r["label"]: r for r in ev.classification_report(df, "o", "p", ["A", "B", "C"]).collect()}
    assert got["A"]["precision"] == 0.5 and got["A"]["recall"] == 1.0
    assert got["B"]["f1"] == 0.0 and got["C"]["support"] == 0
    assert got["accuracy"]["precision"] == 0.5 and got["accuracy"]["support"] == 2


def test_adjustment_against_direct_rule(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.02]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)], "g string, i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in st.adjust_bh(df, ["g"], ["i"]).collect()}
    order = sorted(range(5), key=lambda i: p[i])
    running, want = 1.0, {}
    for rank in range(5, 0, -1):
        i = order[rank - 1]
        running = min(running, p[i] * 5 / rank)
        want[i] = running
    assert got == pytest.approx(want)


def test_paired_test_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = st.paired_tests(df, "g", ["x", "y"]).collect()
    assert [r["g"] for r in got] == ["a"] and got[0]["t"] == pytest.approx(-3.0)
