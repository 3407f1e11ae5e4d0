"""Hand-made edge frames: missing values, ties, nulls in keys, rule tables."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import rowwise as rw
from cohortloom.functions.rules import clinical_flags, code_columns, with_clinical_flags
from cohortloom.functions.tails import t_two_sided
from cohortloom.operators import aggregates as ag
from cohortloom.operators import columns as co
from cohortloom.operators import filters as fl
from cohortloom.operators import joins as jn
from cohortloom.operators import topics as tp
from cohortloom.operators.baseline import Baseline, CohortBaselines
from cohortloom.plans.clinical import with_combination, with_discordance

NAN = float("nan")


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*(keys or df.columns[:1])).collect()]


def test_baseline_is_population_spread_with_floor(spark):
    ref = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, `b/1` double")
    base = Baseline.fit(ref, ["a", "b/1"])
    assert base.means == [2.0, 5.0]
    assert base.stds == [1.0 + 1e-8, 1e-8]


def test_missing_reference_value_gives_nan_unless_skipped(spark):
    ref = spark.createDataFrame([(1.0,), (None,)], "a double")
    assert math.isnan(Baseline.fit(ref, ["a"]).means[0])
    assert Baseline.fit(ref, ["a"], "skip").means == [1.0]


def test_loss_scores_clip_and_keep_missing(spark):
    base = Baseline(["a"], [2.0], [1.0])
    df = spark.createDataFrame([(1, 0.5), (2, 3.0), (3, None), (4, NAN)], "id int, a double")
    got = dict(rows(base.apply(df), "id"))
    assert got[1] == 1.5 and got[2] == 0.0 and got[3] is None and math.isnan(got[4])
    assert dict(rows(base.apply(df, clip=False), "id"))[1] == -1.5


def test_unfitted_and_empty_guards(spark):
    with pytest.raises(ValueError):
        Baseline.fit(spark.createDataFrame([(1.0,)], "a double"), [])
    with pytest.raises(ValueError):
        Baseline.fit(spark.createDataFrame([], "a double"), ["a"])


def test_cohorts_use_their_own_reference(spark):
    ref = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 10.0), ("y", 14.0)], "c string, a double")
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 10.0)], "id int, c string, a double")
    got = {r["id"]: r["a"] for r in CohortBaselines.fit(ref, "c", ["a"]).apply(df).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-6) and got[2] == pytest.approx(1.0, abs=1e-6)


def test_argmax_takes_first_and_skips_missing(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, 0.1), (2, None, NAN, 0.1), (3, None, None, None)],
        "id int, `p/low` double, `p/mid` double, `p/high` double",
    )
    names = ["p/low", "p/mid", "p/high"]
    got = dict(rows(df.select("id", rw.argmax_label(names, "p/").alias("s")), "id"))
    assert got == {1: "low", 2: "high", 3: None}
    won = df.select("id", *[v.alias(n) for n, v in rw.winner_flags(names).items()])
    assert rows(won, "id") == [(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_discordance_handles_case_padding_and_blanks(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 0.1, 0.0, " LOW "), (2, 0.1, 0.9, 0.0, "low"), (3, 0.1, 0.9, 0.0, "High"), (4, 0.1, 0.9, 0.0, None),
         (5, 0.1, 0.9, 0.0, "other")],
        "id int, `p/low` double, `p/mid` double, `p/high` double, gt string",
    )
    got = with_discordance(df, ["p/low", "p/mid", "p/high"], "p/", F.col("gt"))
    assert [r["stage_group"] for r in got.orderBy("id").collect()] == [
        "Canonical", "Overpredict", "Underpredict", None, None
    ]


def test_threshold_stage_needs_only_second_for_high(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 2.0, 1.9), (3, None, 2.0), (4, None, 1.0), (5, 3.0, NAN)], "id int, m double, n double"
    )
    got = dict(rows(df.select("id", rw.threshold_stage(F.col("m"), F.col("n")).alias("s")), "id"))
    assert got == {1: "low", 2: "mid", 3: "high", 4: None, 5: None}


def test_joined_labels_and_counts(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 0, 1), (3, 0, 0), (4, None, None)], "id int, AD int, LBD int")
    got = with_combination(df, ["AD", "LBD"]).select("id", "combination", "n_labels")
    assert rows(got, "id") == [(1, "AD+LBD", 2), (2, "LBD", 1), (3, None, None), (4, None, None)]


def test_clinical_rules(spark):
    columns = code_columns()

    def subject(i, **codes):
        return (i, *[codes.get(c) for c in columns])

    data = [
        subject(1, NACCUDSD=4, NACCALZP=2, NACCPPME=1),
        subject(2, NACCUDSD=3, NACCALZP=1, PARK=1, NACCPPME=2),
        subject(3, NACCUDSD=4),
        subject(4, NACCUDSD=4, NACCLBDP=1, MSAIF=2, NACCPPME=7),
        subject(5),
    ]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} int" for c in columns))
    got = {r["id"]: r.asDict() for r in with_clinical_flags(df).collect()}
    assert (got[1]["AD"], got[1]["ODE"], got[1]["DE"]) == (1, 0, 1)
    assert (got[1]["nfvPPA"], got[1]["svPPA"]) == (1, None)
    assert (got[2]["AD"], got[2]["PD"], got[2]["MCI"]) == (0, 1, 1)
    assert (got[2]["nfvPPA"], got[2]["svPPA"]) == (None, 1)
    assert got[3]["ODE"] == 1 and got[4]["ODE"] == 1 and got[4]["LBD"] == 1
    assert (got[4]["nfvPPA"], got[4]["svPPA"]) == (0, 0)
    assert all(got[5][f] == 0 for f in clinical_flags())
    filled = with_clinical_flags(df, fill_zero=True).filter("id = 1").first()
    assert filled["svPPA"] == 0


def test_weighted_mean_counts_repeats_and_needs_all(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, None, 4.0)], "id int, a double, b double")
    pairs = [("a", 2.0), ("a", 2.0), ("b", 1.0), ("absent", 9.0)]
    got = dict(rows(df.select("id", rw.weighted_mean(pairs, df.columns).alias("m")), "id"))
    assert got == {1: pytest.approx(8.0 / 5.0), 2: None}


def test_text_key_and_stars(spark):
    df = spark.createDataFrame([(1.0,), (1.5,)], "k double").select(co.text_key(F.col("k")).alias("t"))
    assert sorted(r["t"] for r in df.collect()) == ["1", "1.5"]
    p = spark.createDataFrame([(1e-5,), (5e-4,), (0.005,), (0.05,), (0.2,)], "p double")
    assert [r[0] for r in p.select(rw.stars(F.col("p"))).collect()] == ["****", "***", "**", "*", None]


def test_t_tail_known_values(spark):
    df = spark.createDataFrame([(2.228, 10), (0.0, 5), (12.706, 1), (None, 3)], "t double, n int")
    got = [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4)
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.05, abs=1e-4) and got[3] is None


def test_t_tail_over_many_sizes(spark):
    # the integral of the density, by t = sqrt(n) tan(u)
    import math

    cases = [(t, n) for t in (0.1, 1.0, 2.5, 40.0, -3.0) for n in (1, 2, 7, 60, 20_000)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t double, n int")
    got = dict(rows(df.select("i", t_two_sided(F.col("t"), F.col("n")).alias("p")), "i"))
    for i, (t, n) in enumerate(cases):
        u = min(math.atan(abs(t) / math.sqrt(n)), 14 / math.sqrt(n))
        cells = [(1 if k in (0, 4000) else 4 if k % 2 else 2) * math.cos(u * k / 4000) ** (n - 1) for k in range(4001)]
        inside = 2 * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) * u / 12000 * sum(cells)
        assert got[i] == pytest.approx(1 - inside, abs=1e-9)
    edge = spark.createDataFrame([(float("inf"), 3), (1.0, 0), (float("nan"), 3), (1.0, None)], "t double, n int")
    assert [r[0] for r in edge.select(t_two_sided(F.col("t"), F.col("n"))).collect()] == [0.0, None, None, None]


def test_trend_lines_in_one_scan(spark):
    from cohortloom.operators.stats import trend_line, trend_lines

    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0), (2.0, None, 5.0), (3.0, 1.0, 7.0), (nan, 4.0, 1.0), (4.0, 0.5, nan)], "a double, b double, y double"
    )
    got = {r["feature"]: (r["slope"], r["intercept"]) for r in trend_lines(df, ["a", "b"], "y").collect()}
    assert got["a"] == (pytest.approx(2.0), pytest.approx(1.0))
    one = trend_line(df, "b", "y").first()
    assert got["b"] == (pytest.approx(one["slope"]), pytest.approx(one["intercept"]))
    assert trend_lines(df.limit(0), ["a"], "y").count() == 0


def test_column_range_errors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert co.column_range(df, "a", "b") == ["a", "b"]
    for first, last in (("b", "a"), ("a", "z")):
        with pytest.raises(ValueError):
            co.column_range(df, first, last)


def test_filters_keep_missing_like_pandas(spark):
    df = spark.createDataFrame([(1, "NC"), (2, "AD"), (3, None)], "id int, dx string")
    assert [r["id"] for r in fl.differs_from(df, "dx", "NC").orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in fl.exclude_matching(df, "dx", "NC|MCI").orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in fl.keep_labels(df, "dx", exclude=["AD"]).orderBy("id").collect()] == [1, 3]
    numbers = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None)], "id int, v double")
    assert [r["id"] for r in fl.drop_incomplete(numbers, ["v"]).collect()] == [1]
    with pytest.raises(ValueError, match="v"):
        fl.require_complete(numbers, ["v"])


def test_group_means_drop_missing_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0)], "g string, v double")
    assert rows(ag.group_means(df, "g", ["v"])) == [("a", 2.0)]
    assert {r["g"]: r["prop"] for r in ag.group_shares(df, "g").collect()}[None] == pytest.approx(1 / 3)


def test_merge_null_keys_and_fan_out(spark):
    left = spark.createDataFrame([(1, None), (2, "k")], "id int, k string")
    right = spark.createDataFrame([(None, 10), ("k", 20), ("k", 21)], "k string, v int")
    assert rows(jn.merge(left, right, ["k"], null_safe=True).select("id", "v"), "id", "v") == [(1, 10), (2, 20), (2, 21)]
    assert rows(jn.merge(left, right, ["k"]).select("id", "v"), "id", "v") == [(1, None), (2, 20), (2, 21)]
    with pytest.raises(ValueError, match="unique"):
        jn.merge(left, right, ["k"], unique_right=True)


def test_lookup_fill_uses_stated_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    lookup = spark.createDataFrame([(1, 2, 9.0), (1, 1, 7.0), (2, 1, 1.0)], "k int, visit int, v double")
    got = jn.fill_from_lookup(df, lookup, ["k"], ["v"], [F.col("visit")])
    assert rows(got) == [(1, 7.0), (2, 5.0)]


def test_weighted_top_scores_skip_absent_columns(spark):
    patterns = tp.pattern_frame(spark, [[0.5, 0.3, 0.2]], ["a", "b", "c"])
    df = spark.createDataFrame([(1, 2.0, 4.0)], "id int, a_ND double, c_ND double")
    got = tp.weighted_top_scores(df, patterns, 2).first()["Topic_0_top10_weighted_z"]
    assert got == pytest.approx(1.0)


def test_names_lacking_is_plain_substring():
    assert rw.names_lacking(["P(AD)", "P(SVAD)", "P(PD)", "P(non-AD)"], "AD") == ["P(PD)"]
