"""Whole preparation plans against plain numpy, and file round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.topics import class_weights_frame, pattern_frame
from cohortloom.plans.clinical import TAU_COLUMNS, prepare_clinical, with_stage_scores
from cohortloom.plans.projection import class_score_tests, class_scores
from cohortloom.functions.rules import code_columns
from cohortloom.runtime import fresh_path, join_small, small_local
from cohortloom.sources.tables import header_names, read_csv, read_keyed_csv, write_csv


def test_class_scores_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(2, 0.5, (60, 6))
    names = [f"VA/{i}" for i in range(6)]
    dx = ["CN" if i < 20 else "AD" for i in range(60)]
    labels = ["NC" if i < 20 else "NC+PD" if i < 40 else "AD" if i < 58 else None for i in range(60)]
    schema = "id int, DX string, combination string, " + ", ".join(f"`{n}` double" for n in names)
    df = spark.createDataFrame([(i, dx[i], labels[i], *map(float, x[i])) for i in range(60)], schema)
    beta = rng.dirichlet(np.ones(6), 3)
    weights = {"A": {0: 0.7, 2: 0.3}, "B": {1: 1.0}}
    patterns = pattern_frame(spark, beta, names)
    scored = class_scores(df, names, patterns, class_weights_frame(spark, weights, 3), top=4)
    got = {r["id"]: (r["ND_A"], r["ND_B"]) for r in scored.collect()}

    ref = x[:20]
    z = np.maximum(-(x - ref.mean(axis=0)) / (ref.std(axis=0) + 1e-8), 0)
    topic = np.zeros((60, 3))
    for k in range(3):
        top = np.argsort(-beta[k])[:4]
        topic[:, k] = z[:, top] @ beta[k, top]
    # 'NC' rows and rows without a combination are gone, 'NC+PD' was renamed first
    assert sorted(got) == list(range(20, 58))
    for i, (a, b) in got.items():
        assert a == pytest.approx(0.7 * topic[i, 0] + 0.3 * topic[i, 2]) and b == pytest.approx(topic[i, 1])
    tests = class_score_tests(scored, significant=False).collect()
    assert {r["combination"] for r in tests} == {"PD", "AD"} and all(0 <= r["p_adjusted"] <= 1 for r in tests)


def test_clinical_preparation_fills_from_first_visit(spark):
    keys = "NACCID int, NACCVNUM int, NACCAGEB int, NACCAGE int, SEX int, EDUC int, NACCMMSE int, NACCNE4S int"
    codes = code_columns()
    images = spark.createDataFrame(
        [(1, 1, 70, 71, 1, 12, None, 0, 0.5), (2, 1, 60, 61, 0, None, 28, 1, 0.7)], keys + ", `VA/2` double"
    )

    def visit(*demo, **given):
        return (*demo, *[given.get(c) for c in codes])

    clinical = spark.createDataFrame(
        [visit(1, 1, 70, 71, 1, 12, None, 0, NACCUDSD=4, NACCALZP=1, NACCLBDP=2),
         visit(2, 1, 60, 61, 0, 16, 28, 1, NACCUDSD=1)],
        keys + ", " + ", ".join(f"{c} int" for c in codes),
    )
    got = {r["NACCID"]: r for r in prepare_clinical(images, clinical, [F.col("NACCAGE")]).collect()}
    # missing keys match missing keys; a differing key leaves no codes but is filled afterwards
    assert got[1]["combination"] == "AD+LBD" and got[1]["n_labels"] == 2
    assert got[2]["combination"] is None and got[2]["EDUC"] == 16


def test_stage_scores_from_two_groups(spark):
    rng = np.random.default_rng(2)
    high = np.arange(200) >= 150
    rows = [(i, *[float(v) for v in rng.normal(3.0 if high[i] else 1.0, 0.1, len(TAU_COLUMNS))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"`{c}` double" for c in TAU_COLUMNS.values()))
    staged = with_stage_scores(df, dict.fromkeys(TAU_COLUMNS, 10)).toPandas().set_index("id")
    assert (staged["TAU/stage_aa_gt"][high] == "high").all()
    assert (staged["TAU/stage_aa_gt"][~high] == "low").mean() > 0.9


def test_csv_round_trip_with_inferred_types(spark):
    df = spark.createDataFrame([("r1", 1.5, None), ("r2", 2.5, 7)], "key string, a double, b int")
    path = write_csv(df, fresh_path(spark, "csv"), key="key")
    back = read_csv(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == [("r1", 1.5, None), ("r2", 2.5, 7)]
    assert read_keyed_csv(spark, path, "ROI").columns == ["ROI", "a", "b"]
    assert [tuple(r) for r in header_names(df.limit(1)).collect()] == [(0, "r1"), (1, "1.5"), (2, None)]


def test_small_tables_are_counted_before_broadcast(spark):
    big, small = spark.range(100), spark.range(50)
    assert small_local(small, 10) is None and small_local(small, 50).count() == 50
    for limit in (10, 100):
        assert join_small(big, small, ["id"], limit=limit).count() == 50
    plan = join_small(big, small, ["id"], limit=100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
