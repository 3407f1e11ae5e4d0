"""Missing values, refused input, pieces and brackets that stay small."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.models.lda import TopicModel
from cohortloom.models.nmf import FactorModel
from cohortloom.operators import aggregates as ag
from cohortloom.operators import evaluate as ev
from cohortloom.operators import figdata as fd
from cohortloom.operators import ranking as rk
from cohortloom.operators import spread
from cohortloom.operators.baseline import CohortBaselines
from cohortloom.plans.analysis import CohortModel

NAN = float("nan")


@pytest.mark.parametrize("bad,word", [(NAN, "missing"), (None, "missing"), (-1.0, "negative")])
def test_fits_refuse_bad_input_by_name(spark, bad, word):
    rows = spark.createDataFrame([(i, 1.0 + i, 2.0, "A" if i % 2 else "B") for i in range(6)] + [(9, bad, 1.0, "A")], "PTID long, f1 double, f2 double, DX string")
    for fit in (lambda: TopicModel(2, max_iter=2).fit(rows, ["f2", "f1"]), lambda: FactorModel(2, max_iter=2).fit(rows, ["f2", "f1"]),
                lambda: CohortModel(n_topics=2, max_iter=2).fit(rows, ["f2", "f1"], standardize=False)):
        with pytest.raises(ValueError, match="f1"):
            fit()
    with pytest.raises(ValueError, match=word):
        TopicModel(2, max_iter=2).fit(rows, ["f2", "f1"])


def test_topic_fit_makes_all_passes_unless_told(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (0.0, 4.0)], "f1 double, f2 double")
    model = TopicModel(2, max_iter=7).fit(rows, ["f1", "f2"], with_perplexity=False)
    assert model.n_iter_ == 7 and not model.converged_
    model = TopicModel(2, max_iter=500, tol=0.01).fit(rows, ["f1", "f2"], with_perplexity=False)
    assert model.n_iter_ < 500 and model.converged_


def test_nan_comes_last_and_is_no_mean(spark):
    rows = spark.createDataFrame([(1, "a", NAN), (2, "a", 5.0), (3, "a", None), (4, "a", 7.0)], "id long, g string, s double")
    placed = spread.sorted_position(rows, rk.group_then_score(rows, "g", ["a"], "s", ["id"])).orderBy("position").collect()
    assert [r.id for r in placed][:2] == [4, 2]
    assert [r.id for r in rk.top_per_group(rows, "g", "s", "id", 2).orderBy("rank").collect()] == [4, 2]
    assert fd.class_profiles(rows, "g", ["s"]).first()["mean"] == 6.0
    assert rk.best_setting(rows, "id", "s", smallest=False).first()["id"] == 4
    means = spark.createDataFrame([("a", 1.0), ("b", NAN), ("c", 3.0)], "g string, m double")
    assert ag.contrast_to_others(means, "g", "a", ["m"]).first()["contrast"] == -2.0


def test_accuracy_of_the_report_is_over_all_rows(spark):
    rows = spark.createDataFrame([("A", "A"), ("Z", "A"), (None, "A")], "t string, p string")
    last = ev.classification_report(rows, "t", "p", ["A", "B"]).filter("label = 'accuracy'").first()
    assert last["precision"] == 0.5 and last["support"] == 2


def test_rows_of_a_cohort_without_reference_stay(spark):
    reference = spark.createDataFrame([("x", 1.0), ("x", 3.0)], "site string, f double")
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "site string, f double")
    found = {r.site: r.f for r in CohortBaselines.fit(reference, "site", ["f"]).apply(rows).collect()}
    assert found["y"] is None and found["x"] == pytest.approx(1.0, abs=1e-6)


def test_a_class_below_its_cap_is_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(spread, "PIECE_ROWS", 100)
    rows = spark.range(4000).withColumn("g", F.when(F.col("id") < 3000, "large").otherwise("small"))
    for cap in (5000, 2000, 50):
        kept = spread.hash_cut(rows, "g", ["id"], F.lit(cap))
        assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"large": min(cap, 3000), "small": min(cap, 1000)}
    plan = spread.hash_cut(rows, "g", ["id"], F.lit(5000))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= 2 and "_size" in plan
    assert rk.sample_rows(rows, ["id"], 9999).count() == 4000


def test_quantile_brackets_stay_small(spark):
    accuracy = 50
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.hash("id") / 7.0).alias("v"))
    found = {r.g: (r.q0, r.q1, r.q2) for r in spread.exact_quantiles(rows, ["g"], "v", [0.1, 0.5, 0.99], accuracy).collect()}
    for g in (0, 1):
        values = sorted(r.v for r in rows.filter(F.col("g") == g).collect())
        for q, p in zip(found[g], (0.1, 0.5, 0.99)):
            at = (len(values) - 1) * p
            low = values[math.floor(at)]
            assert q == pytest.approx(low + (values[math.ceil(at)] - low) * (at - math.floor(at)), rel=1e-12)
    ties = rows.withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(F.floor(F.col("v") / 1e6).cast("double")))
    assert spread.exact_quantiles(ties, ["g"], "v", [0.9], accuracy).first()["q0"] == 1.0


def test_dominant_topic_skips_nan(spark):
    from cohortloom.operators.ranking import order_by_dominant

    rows = [(1, "a", float("nan"), 0.2, 0.7), (2, "a", 0.5, 0.5, float("nan")), (3, "a", None, None, 0.1)]
    got = order_by_dominant(spark.createDataFrame(rows, "id int, DX string, t0 double, t1 double, t2 double"), "DX", ["t0", "t1", "t2"], ["id"])
    assert {r.id: r.dominant for r in got.collect()} == {1: 2, 2: 0, 3: 2}
