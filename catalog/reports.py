"""Statistics, figure tables and the multi-step preparation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import COHORT, FEATURES, FLAGS, PATTERNS, PREDICTIONS, PROBS, STAGE_COLUMNS, STAGED, STAGE_GROUPS, TOPICS, \
    WEIGHTS, q, table
from catalog.registry import query, r, rounded
from catalog.relational import COMBINED, GROUP_ORDER, PLACED, patterns
from catalog.scalars import CLINICAL_FLAG_SQL, CLINICAL_SQL, CODE_NAMES, MANUAL, clinical_codes
from catalog.tables import staged
from cohortloom.functions.rowwise import named
from cohortloom.functions.rules import COMBINATION_FLAGS
from cohortloom.operators import figdata as fd
from cohortloom.operators import stats as st
from cohortloom.operators.topics import class_weights_frame
from cohortloom.plans.clinical import MEDIAL_LABELS, NEOCORTEX_LABELS, TAU_COLUMNS, prepare_clinical, with_combination, \
    with_stage_scores
from cohortloom.plans.projection import class_scores, class_score_tests

LI = ["l_quantity", "l_discount", "l_tax"]


# ---- statistics --------------------------------------------------------------------------
@query(
    "sg1_correlation_with_target",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS feature, count(*) AS n, {r(f'corr({c}, l_extendedprice)')} AS r "
        "FROM lineitem GROUP BY l_returnflag"
        for c in LI
    ),
)
def _(spark, d):
    made = st.pearson_with_target(table(spark, d, "lineitem"), LI, "l_extendedprice", ["l_returnflag"])
    return rounded(made.drop("p"))


def p_sql(tests: str, keep: str) -> str:
    """Two-sided p of ``t`` with ``dof`` in ``tests``: Simpson sums of cos(u)^(dof-1), where t = sqrt(dof) tan(u).

    Beyond 14 standard deviations the rest of the sum is below 1e-40.
    """
    return (
        f"bound AS (SELECT *, least(atan(abs(t) / sqrt(dof)), 14 / sqrt(dof)) AS u FROM {tests}), "
        "step AS (SELECT unnest(range(0, 2001)) AS i), "
        f"tailed AS (SELECT {keep}, any_value(n) AS n, any_value(t) AS t, 1 - 2 * exp(lgamma((any_value(dof) + 1) / 2.0) "
        "- lgamma(any_value(dof) / 2.0)) / sqrt(pi()) * any_value(u) / 6000 * sum((CASE WHEN i IN (0, 2000) THEN 1 "
        "WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(u * i / 2000), dof - 1)) AS p "
        f"FROM bound CROSS JOIN step GROUP BY {keep})"
    )


@query(
    "sg1b_correlation_p_values",
    "WITH c AS ("
    + " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS feature, count(*) AS n, corr({c}, l_extendedprice) AS r FROM lineitem GROUP BY l_returnflag"
        for c in LI
    )
    + "), tt AS (SELECT *, n - 2 AS dof, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c), "
    + p_sql("tt", "l_returnflag, feature, r")
    + f" SELECT l_returnflag, feature, n, {r('r')} AS r, {r('abs(p)')} AS p FROM tailed",
)
def _(spark, d):
    return rounded(st.pearson_with_target(table(spark, d, "lineitem"), LI, "l_extendedprice", ["l_returnflag"]))


@query(
    "sg2_trend_line",
    f"SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, "
    f"{r('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem GROUP BY l_returnflag",
)
def _(spark, d):
    return rounded(st.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 3)


PAIRS3 = [(TOPICS[i], TOPICS[j]) for i in range(4) for j in range(i + 1, 4)]
TESTS = (
    WEIGHTS + ", tests AS ("
    + " UNION ALL ".join(
        f"SELECT DX, '{a}' AS first, '{b}' AS second, count(*) AS n, avg({a} - {b}) AS mean_diff, "
        f"avg({a} - {b}) / (stddev_samp({a} - {b}) / sqrt(count(*))) AS t FROM weights GROUP BY DX HAVING count(*) > 1"
        for a, b in PAIRS3
    )
    + ")"
)


@query("sg3_paired_tests", f"WITH {TESTS} SELECT DX, first, second, n, {r('mean_diff')} AS mean_diff, {r('t')} AS t FROM tests")
def _(spark, d):
    return rounded(st.paired_tests(fr.topic_weights(spark, d), "DX", TOPICS).drop("p"))


@query(
    "sg3b_paired_test_p_values",
    f"WITH {TESTS}, tt AS (SELECT *, n - 1 AS dof FROM tests), "
    + p_sql("tt", "DX, first, second, mean_diff")
    + f" SELECT DX, first, second, n, {r('mean_diff')} AS mean_diff, {r('t')} AS t, {r('abs(p)')} AS p FROM tailed",
)
def _(spark, d):
    return rounded(st.paired_tests(fr.topic_weights(spark, d), "DX", TOPICS))


ADJUSTED = (
    TESTS + ", tt AS (SELECT *, n - 1 AS dof FROM tests), " + p_sql("tt", "DX, first, second")
    + ", p AS (SELECT DX, first, second, abs(p) AS p FROM tailed), k AS (SELECT *, row_number() OVER (PARTITION BY DX ORDER BY p, first, second) AS k, "
    "count(*) OVER (PARTITION BY DX) AS m FROM p), a AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY DX ORDER BY k DESC "
    "ROWS UNBOUNDED PRECEDING), 1.0) AS p_adjusted FROM k)"
)


def _adjusted(spark, d):
    tests = st.paired_tests(fr.topic_weights(spark, d), "DX", TOPICS)
    return st.adjust_bh(tests, ["DX"], ["first", "second"]).select("DX", "first", "second", "p", "p_adjusted")


@query("sg4_false_discovery_adjustment", f"WITH {ADJUSTED} SELECT DX, first, second, {r('p')} AS p, {r('p_adjusted')} AS p_adjusted FROM a")
def _(spark, d):
    return rounded(_adjusted(spark, d))


@query(
    "sg5_significant_with_stars",
    f"WITH {ADJUSTED} SELECT DX, first, second, CASE WHEN p_adjusted <= 1e-4 THEN '****' WHEN p_adjusted <= 1e-3 THEN '***' "
    "WHEN p_adjusted <= 1e-2 THEN '**' ELSE '*' END AS code FROM a WHERE p_adjusted <= 5e-2",
)
def _(spark, d):
    return st.significant_only(_adjusted(spark, d)).select("DX", "first", "second", "code")


PART_VALUES = {"discount": "CAST(l_discount AS DOUBLE)", "line": "l_linenumber / 80.0D", "tax": "CAST(l_tax AS DOUBLE)"}
PART_PAIRS = [("discount", "line"), ("discount", "tax"), ("line", "tax")]


@query(
    "sg5b_significant_pairs_by_part",
    "WITH v AS (SELECT l_partkey, " + ", ".join(f"{e.replace('80.0D', '80.0')} AS {n}" for n, e in PART_VALUES.items()) + " FROM lineitem), tests AS ("
    + " UNION ALL ".join(
        f"SELECT l_partkey, '{a}' AS first, '{b}' AS second, count(*) AS n, avg({a} - {b}) / (stddev_samp({a} - {b}) / sqrt(count(*))) AS t "
        "FROM v GROUP BY l_partkey HAVING count(*) > 1 AND stddev_samp({a} - {b}) > 0".replace("{a}", a).replace("{b}", b)
        for a, b in PART_PAIRS
    )
    + "), tt AS (SELECT *, n - 1 AS dof FROM tests), " + p_sql("tt", "l_partkey, first, second")
    + ", p AS (SELECT l_partkey, first, second, abs(p) AS p FROM tailed), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p, first, second) AS k, "
    "count(*) OVER (PARTITION BY l_partkey) AS m FROM p), a AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY l_partkey ORDER BY k DESC "
    "ROWS UNBOUNDED PRECEDING), 1.0) AS p_adjusted FROM k) SELECT l_partkey, first, second, CASE WHEN p_adjusted <= 1e-4 THEN '****' "
    "WHEN p_adjusted <= 1e-3 THEN '***' WHEN p_adjusted <= 1e-2 THEN '**' ELSE '*' END AS code FROM a WHERE p_adjusted <= 5e-2",
)
def _(spark, d):
    values = table(spark, d, "lineitem").selectExpr("l_partkey", *[f"{e} AS {n}" for n, e in PART_VALUES.items()])
    adjusted = st.adjust_bh(st.paired_tests(values, "l_partkey", list(PART_VALUES)), ["l_partkey"], ["first", "second"])
    return st.significant_only(adjusted).select("l_partkey", "first", "second", "code")


# ---- figure tables -------------------------------------------------------------------------
PREDICTED = ", ".join(q(c) for c in STAGE_COLUMNS)
PROFILES = (
    WEIGHTS + ", means AS (" + " UNION ALL ".join(
        f"SELECT DX, count(*) AS n, '{t}' AS feature, avg({t}) AS mean FROM weights GROUP BY DX" for t in TOPICS) + ")"
)


@query(
    "fd1_class_profiles",
    f"WITH {PROFILES} SELECT DX, n, feature, {r('mean')} AS mean, {r('max(mean) OVER () * 1.1')} AS y_max FROM means",
)
def _(spark, d):
    return rounded(fd.class_profiles(fr.topic_weights(spark, d), "DX", TOPICS))


@query(
    "fd2_combination_profiles",
    f"WITH {COMBINED}, c AS (SELECT replace(combination, 'FTD_ANY', 'FTD') AS combination, "
    "CAST(len(string_split(combination, '+')) AS INTEGER) AS n_labels, price, n_orders FROM combined WHERE combination IS NOT NULL), "
    "g AS (SELECT combination, n_labels, count(*) AS n, 'price' AS feature, avg(price) AS mean FROM c GROUP BY 1, 2 UNION ALL "
    "SELECT combination, n_labels, count(*), 'n_orders', avg(n_orders) FROM c GROUP BY 1, 2) "
    f"SELECT combination, n_labels, n, feature, {r('mean')} AS mean, {r('max(mean) OVER () * 1.1')} AS y_max FROM g",
)
def _(spark, d):
    combined = with_combination(fr.flags(spark, d), FLAGS)
    return rounded(fd.combination_profiles(combined, "combination", "n_labels", ["price", "n_orders"]))


@query(
    "fd3_group_probability_heatmap",
    f"WITH {PREDICTIONS}, m AS (SELECT DX_true, " + ", ".join(f"{r(f'avg({q(p)})')} AS {q(p)}" for p in PROBS)
    + " FROM predictions GROUP BY DX_true), ord AS (SELECT * FROM (VALUES ('C', 0), ('A', 1), ('none', 2)) t(DX_true, order_idx)) "
    'SELECT ord.DX_true, order_idx, "P(A)", "P(B)", "P(C)" FROM ord LEFT JOIN m ON ord.DX_true = m.DX_true',
)
def _(spark, d):
    return rounded(fd.group_probability_heatmap(fr.predictions(spark, d), "DX_true", ["C", "A", "none"], PROBS))


@query(
    "fd4_subject_heatmap",
    f"WITH {STAGED}, g AS (SELECT stage_group, count(*) AS n, {GROUP_ORDER} AS o FROM staged WHERE stage_group IS NOT NULL GROUP BY 1), "
    'e AS (SELECT *, CAST(sum(n) OVER (ORDER BY o) AS BIGINT) AS "end" FROM g), '
    f"p AS (SELECT o_orderkey, stage_group, o_totalprice, {PREDICTED}, row_number() OVER (ORDER BY "
    f'{GROUP_ORDER} NULLS LAST, o_totalprice DESC, o_orderkey) AS "position" FROM staged) '
    'SELECT p.*, e."end" FROM p LEFT JOIN e ON p.stage_group = e.stage_group',
)
def _(spark, d):
    s = staged(spark, d)
    names = ["o_totalprice", *STAGE_COLUMNS]
    placed, bounds = fd.subject_heatmap(s, "stage_group", STAGE_GROUPS, "o_totalprice", names, ["o_orderkey"])
    return placed.join(F.broadcast(bounds.select("stage_group", "end")), "stage_group", "left")  # three rows


@query(
    "fd5_group_topic_profiles",
    f"WITH {PROFILES} SELECT DX, n, feature, {r('mean')} AS mean, {r('max(mean) OVER ()')} AS y_max FROM means",
)
def _(spark, d):
    return rounded(fd.group_topic_profiles(fr.topic_weights(spark, d), "DX", TOPICS))


@query(
    "fd6_stacked_mixtures",
    f'WITH {PLACED} SELECT o_orderkey, "position", DX_true <> DX_pred AS misclassified, \'P(A)\' AS topic, 0.0::DOUBLE AS bottom, '
    f'{r(q("P(A)"))} AS height FROM placed UNION ALL SELECT o_orderkey, "position", DX_true <> DX_pred, \'P(B)\', {r(q("P(A)"))}, '
    f'{r(q("P(B)"))} FROM placed UNION ALL SELECT o_orderkey, "position", DX_true <> DX_pred, \'P(C)\', '
    f'{r(q("P(A)") + " + " + q("P(B)"))}, {r(q("P(C)"))} FROM placed',
)
def _(spark, d):
    made = fd.stacked_mixtures(fr.predictions(spark, d), "DX_true", "DX_pred", ["A", "B", "C"], PROBS, ["o_orderkey"])
    return rounded(made)


@query(
    "fd7_ordered_probabilities",
    f'WITH {PLACED} SELECT o_orderkey, DX_true, {", ".join(f"{r(q(p))} AS {q(p)}" for p in PROBS)}, "position" FROM placed',
)
def _(spark, d):
    made = fd.ordered_probabilities(fr.predictions(spark, d), "DX_true", ["o_orderkey"], ["A", "B", "C"])
    return rounded(made)


@query(
    "fd8_topic_heatmap_and_top_bars",
    f"WITH {PATTERNS}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, pos) AS rank FROM patterns) "
    f"SELECT topic, pos, feature, {r('weight')} AS weight, CASE WHEN rank <= 10 THEN CAST(rank AS INTEGER) END AS rank FROM k",
)
def _(spark, d):
    full, top = fd.topic_heatmap(patterns(spark, d), 10)
    return rounded(full.join(top.select("topic", "pos", "rank"), ["topic", "pos"], "left"))


LONG_WEIGHTS = (
    WEIGHTS + ", l AS (" + " UNION ALL ".join(f"SELECT DX, '{t}' AS topic, {t} AS v FROM weights" for t in TOPICS)
    + "), b AS (SELECT DX, topic, count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, "
    "quantile_cont(v, 0.75) AS c FROM l GROUP BY ALL)"
)


@query(
    "fd9_topic_boxes_by_class",
    f"WITH {LONG_WEIGHTS} SELECT b.DX, b.topic, n, {r('a')} AS quartile_1, {r('m')} AS median, {r('c')} AS quartile_3, "
    + r("min(v) FILTER (WHERE v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))") + " AS whisker_low, "
    + r("max(v) FILTER (WHERE v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))") + " AS whisker_high, "
    "count(*) FILTER (WHERE v NOT BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) AS n_outliers "
    "FROM b JOIN l ON b.DX = l.DX AND b.topic = l.topic GROUP BY b.DX, b.topic, n, a, m, c",
)
def _(spark, d):
    return rounded(fd.topic_boxes(fr.topic_weights(spark, d), "DX", TOPICS))


STAGE_FAMILY = ["o_totalprice", *STAGE_COLUMNS]
GROUPED = f"SELECT stage_group, count(*) AS n, {GROUP_ORDER} AS o, " + ", ".join(
    f"avg({q(c)}) AS {q(c)}" for c in STAGE_FAMILY) + " FROM staged WHERE stage_group IS NOT NULL GROUP BY 1"


def _panel(panel, key, value, feature="NULL", position="NULL", digits=4):
    return (f"SELECT '{panel}' AS panel, {key} AS key, {feature} AS feature, CAST({position} AS BIGINT) AS \"position\", "
            f"{r(value, digits)} AS value")


@query(
    "fd10_discordance_panels",
    f"WITH {STAGED}, g AS ({GROUPED}), placed AS (SELECT *, row_number() OVER (ORDER BY {GROUP_ORDER} NULLS LAST, "
    'o_totalprice DESC, o_orderkey) AS "position" FROM staged), ends AS (SELECT *, sum(n) OVER (ORDER BY o) AS last FROM g), '
    "peak AS (SELECT max(greatest(" + ", ".join(q(c) for c in STAGE_FAMILY) + ")) AS top FROM g) "
    + " UNION ALL ".join(
        part
        for c in STAGE_FAMILY
        for part in (
            _panel("means", "stage_group", q(c), f"'{c}'", "o") + " FROM g",
            _panel("profiles", "stage_group", q(c), f"'{c}'", "n") + " FROM g",
            _panel("subjects", "CAST(o_orderkey AS VARCHAR)", q(c), f"'{c}'", '"position"') + " FROM placed",
            _panel("correlations", "NULL", f"corr({q(c)}, o_totalprice)", f"'{c}'", f"count({q(c)})") + " FROM staged",
            _panel("slopes", "NULL", f"regr_slope(o_totalprice, {q(c)})", f"'{c}'", digits=2) + " FROM staged",
            _panel("intercepts", "NULL", f"regr_intercept(o_totalprice, {q(c)})", f"'{c}'", digits=2) + " FROM staged",
        )
    )
    + " UNION ALL " + _panel("centers", "stage_group", "last - n / 2.0", "NULL", "last") + " FROM ends"
    + " UNION ALL " + _panel("scale", "NULL", "top") + " FROM peak",
)
def _(spark, d):
    """Every row of every panel; ``position`` is a place or, for profiles and correlations, a number of rows."""
    panels = fd.discordance_panels(
        staged(spark, d), "stage_group", STAGE_GROUPS, STAGE_FAMILY, "o_totalprice", ["o_orderkey"], scatter="o_totalprice"
    )

    def shaped(name, df, key, feature, position, value, digits=4):
        return df.select(F.lit(name).alias("panel"), key.cast("string").alias("key"), feature.cast("string").alias("feature"),
                         position.cast("long").alias("position"), F.round(value, digits).alias("value"))

    none, group, feature = F.lit(None), F.col("stage_group"), F.col("feature")
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), named(c).cast("double").alias("value")) for c in STAGE_FAMILY]))
    long = lambda df, *keep: df.select(*keep, entries.alias("e")).select(*keep, "e.*")
    value = F.col("value")
    parts = [
        shaped("means", long(panels["means"], "stage_group", "order_idx"), group, feature, F.col("order_idx"), value),
        shaped("subjects", long(panels["subjects"], "o_orderkey", "position"), F.col("o_orderkey"), feature, F.col("position"), value),
        shaped("centers", panels["boundaries"], group, none, F.col("end"), F.col("center")),
        shaped("profiles", panels["profiles"], group, feature, F.col("n"), F.col("mean")),
        shaped("scale", panels["profiles"].select("y_max").distinct(), none, none, none, F.col("y_max")),
        shaped("correlations", panels["correlations"], none, feature, F.col("n"), F.col("r")),
        shaped("slopes", panels["lines"], none, feature, none, F.col("slope"), 2),
        shaped("intercepts", panels["lines"], none, feature, none, F.col("intercept"), 2),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query(
    "fd11_flag_panels",
    f"WITH {fr.FLAGS_SQL}, l AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS flag, o_custkey, price, n_orders FROM flags WHERE {f} = 1" for f in FLAGS)
    + "), g AS (SELECT flag, count(*) AS n, avg(n_orders) AS m, avg(price) AS mp FROM l GROUP BY flag HAVING count(*) >= 5) "
    "SELECT l.flag, l.o_custkey, l.price, l.n_orders, row_number() OVER (PARTITION BY l.flag ORDER BY l.price DESC, l.o_custkey) AS \"position\", "
    f"g.n, {r('g.m')} AS mean_orders, {r('g.mp', 3)} AS mean_price FROM l JOIN g ON l.flag = g.flag",
)
def _(spark, d):
    profiles, placed = fd.flag_panels(fr.flags(spark, d), FLAGS, ["n_orders", "price"], "price", ["o_custkey"], 5)
    side = profiles.select("flag", "n", F.col("n_orders").alias("mean_orders"), F.round("price", 3).alias("mean_price"))
    # one row per listed flag
    return rounded(placed.join(F.broadcast(side), "flag"))


CELLS = {"Pred A | True C": ("C", "A"), "Pred B | True C": ("C", "B"), "Pred C | True C": ("C", "C"), "none": ("C", "X")}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BOX = "CASE " + " ".join(f"WHEN DX_true = '{o}' AND DX_pred = '{p}' THEN '{n}'" for n, (o, p) in CELLS.items()) + " END"


@query(
    "fd12_cell_composition",
    f"WITH {PREDICTIONS}, b AS (SELECT {BOX} AS box, o_orderpriority FROM predictions p JOIN orders o "
    "ON p.o_orderkey = o.o_orderkey), s AS (SELECT box, o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY box) AS prop "
    "FROM b WHERE box IS NOT NULL GROUP BY 1, 2), ord AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', {i})" for i, n in enumerate(CELLS))
    + ") t(box, order_idx)) SELECT ord.box, ord.order_idx, "
    + ", ".join(
        f"CASE WHEN count(s.box) > 0 THEN {r(f'coalesce(max(prop) FILTER (WHERE o_orderpriority = {chr(39)}{p}{chr(39)}), 0)')} END AS {q(p)}"
        for p in PRIORITIES
    )
    + " FROM ord LEFT JOIN s ON ord.box = s.box GROUP BY ord.box, ord.order_idx",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    joined = fr.predictions(spark, d).join(o, "o_orderkey")
    return rounded(fd.cell_composition(joined, "DX_true", "DX_pred", CELLS, "o_orderpriority", PRIORITIES))


FENCE = "v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)"


@query(
    "fd13_stage_group_composition",
    f"WITH {STAGED}, i AS (SELECT stage_group, coalesce(\"pred/mid\", 0) + \"pred/high\" AS v, {PREDICTED} FROM staged "
    "WHERE stage_group IS NOT NULL), b AS (SELECT stage_group, count(*) AS n, "
    + ", ".join(f"avg({q(c)}) AS {q('m_' + c)}" for c in STAGE_COLUMNS)
    + ", quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS c FROM i GROUP BY 1) "
    "SELECT b.stage_group, n, " + ", ".join(f"{r('any_value(' + q('m_' + c) + ')')} AS {q(c)}" for c in STAGE_COLUMNS)
    + f", {r('a')} AS quartile_1, {r('m')} AS median, {r('c')} AS quartile_3, {r(f'min(v) FILTER (WHERE {FENCE})')} AS whisker_low, "
    f"{r(f'max(v) FILTER (WHERE {FENCE})')} AS whisker_high, count(*) FILTER (WHERE NOT {FENCE}) AS n_outliers "
    "FROM b JOIN i ON b.stage_group = i.stage_group GROUP BY b.stage_group, n, a, m, c",
)
def _(spark, d):
    means, boxes = fd.stage_group_composition(staged(spark, d), "stage_group", STAGE_COLUMNS, ["pred/mid", "pred/high"])
    return rounded(boxes.join(means, "stage_group"))


@query(
    "fd14_hemisphere_vectors",
    f"WITH {PATTERNS}, k AS (SELECT *, pos - 2 AS slot FROM patterns WHERE pos >= 2) SELECT topic, pos, feature, {r('weight')} AS weight, "
    "CAST(slot AS INTEGER) AS slot, CASE WHEN slot < 31 THEN 'L' ELSE 'R' END AS hemi, "
    f"{r('min(weight) OVER (PARTITION BY topic)')} AS low, {r('max(weight) OVER (PARTITION BY topic)')} AS high FROM k",
)
def _(spark, d):
    return rounded(fd.hemisphere_vectors(patterns(spark, d), "topic", 62))


# ---- preparation plans -----------------------------------------------------------------------
DEMO_SQL = (
    "CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 30 AS INTEGER) END AS \"NACCAGEB\", "
    "CAST(c_custkey % 31 AS INTEGER) AS \"NACCAGE\", CAST(c_custkey % 2 AS INTEGER) AS \"SEX\", "
    "CAST(c_custkey % 20 AS INTEGER) AS \"EDUC\", CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 29 AS INTEGER) END AS \"NACCMMSE\", "
    "CAST(c_custkey % 3 AS INTEGER) AS \"NACCNE4S\""
)


def _clinical_tables(spark, d):
    """Coded visits, and image rows of which every fifth lacks a demographic."""
    key = F.col("c_custkey")
    demo = {
        "NACCAGEB": F.when(key % 6 != 0, (key % 30).cast("int")),
        "NACCAGE": (key % 31).cast("int"),
        "SEX": (key % 2).cast("int"),
        "EDUC": (key % 20).cast("int"),
        "NACCMMSE": F.when(key % 4 != 0, (key % 29).cast("int")),
        "NACCNE4S": (key % 3).cast("int"),
    }
    clinical = clinical_codes(spark, d).withColumns({"NACCID": key, "NACCVNUM": F.lit(1), **demo}).drop("c_custkey")
    images = table(spark, d, "customer").select(
        key.alias("NACCID"), F.lit(1).alias("NACCVNUM"), F.col("c_acctbal").alias("VA/2"),
        *[(F.when(key % 5 != 0, v) if n == "EDUC" else v).alias(n) for n, v in demo.items()],
    )
    return images, clinical


MERGED_FLAGS = {f: CLINICAL_FLAG_SQL[f] for f in COMBINATION_FLAGS}


@query(
    "clinical_preparation",
    f"WITH {CLINICAL_SQL}, demo AS (SELECT c_custkey, c_acctbal, {DEMO_SQL} FROM customer), "
    # an image row without education finds no clinical row with all eight keys
    f"m AS (SELECT d.*, {', '.join(f'CASE WHEN d.c_custkey % 5 <> 0 THEN c.{n} END AS {n}' for n in CODE_NAMES)} "
    "FROM demo d JOIN clinical c ON d.c_custkey = c.c_custkey), "
    "f AS (SELECT *, nullif(concat_ws('+', "
    + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in MERGED_FLAGS.items())
    + "), '') AS combination FROM m) SELECT c_custkey AS \"NACCID\", \"NACCAGEB\", \"EDUC\", \"NACCMMSE\", combination, "
    "CAST(len(string_split(combination, '+')) AS INTEGER) AS n_labels FROM f",
)
def _(spark, d):
    images, clinical = _clinical_tables(spark, d)
    made = prepare_clinical(images, clinical, [F.col("NACCAGE")])
    return made.select("NACCID", "NACCAGEB", "EDUC", "NACCMMSE", "combination", "n_labels")


def _area(labels):
    """The weighted mean of an area's labels, cell i of the vector standing for label i."""
    place = {v: i for i, v in enumerate(TAU_COLUMNS)}
    top = " + ".join(f"({q(f'VA/{place[v] + 1}')} + 1.0) * {100 + place[v]}" for v in labels)
    return f"(({top}) / {sum(100 + place[v] for v in labels)})"


STAGE_SCORES = f"areas AS (SELECT id, {_area(MEDIAL_LABELS)} AS a, {_area(NEOCORTEX_LABELS)} AS b FROM cohort)"


@query(
    "clinical_stage_scores",
    f"WITH RECURSIVE {COHORT}, {STAGE_SCORES}, "
    + fr.mixture_sql("SELECT 'a' AS key, a AS v FROM areas UNION ALL SELECT 'b', b FROM areas")
    + ", z AS (SELECT id, a, (a - (SELECT m1 FROM mixture WHERE key = 'a')) / (SELECT s1 FROM mixture WHERE key = 'a') AS za, "
    "(b - (SELECT m1 FROM mixture WHERE key = 'b')) / (SELECT s1 FROM mixture WHERE key = 'b') AS zb FROM areas) "
    f"SELECT id, {r('a', 4)} AS \"TAU/MTL_SUVR\", CASE WHEN za < 2 AND zb < 2 THEN 'low' WHEN za >= 2 AND zb < 2 THEN 'mid' "
    "WHEN zb >= 2 THEN 'high' END AS \"TAU/stage_aa_gt\" FROM z",
)
def _(spark, d):
    c = fr.cohort(spark, d)
    # vector cells 1..12 stand for the tau columns of the staging labels
    tau = c.select("id", *[(named(f"VA/{i + 1}") + F.lit(1.0)).alias(n) for i, n in enumerate(TAU_COLUMNS.values())])
    staged_scores = with_stage_scores(tau, {label: 100 + i for i, label in enumerate(TAU_COLUMNS)})
    return rounded(staged_scores.select("id", named("TAU/MTL_SUVR"), named("TAU/stage_aa_gt")), 4)


@query("class_score_projection_and_tests")
def _(spark, d):
    c = fr.cohort(spark, d)
    label = F.when(F.col("DX") == "D0", "CN").otherwise(F.col("DX")).alias("DX")
    combination = F.when(F.col("id") % 3 == 0, "AD").when(F.col("id") % 3 == 1, "AD+LBD").otherwise("NC").alias("combination")
    subjects = c.select("id", label, combination, *[named(f) for f in FEATURES])
    weights = class_weights_frame(spark, MANUAL, 9)
    scored = class_scores(subjects, FEATURES, patterns(spark, d), weights)
    return rounded(class_score_tests(scored, significant=False))


