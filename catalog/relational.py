"""Joins, aggregates, rankings and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import (
    CODES, COHORT, COHORT_LONG, FEATURES, FLAGS, FLAGS_SQL, PATTERNS, PREDICTIONS, PROBS, PROFILE, SCORES, STAGED,
    PATTERN_TOPICS, STAGE_GROUPS, TOPICS, VOXELS, WEIGHTS, codes, cohort, q, table,
)
from catalog.registry import query, r, rounded
from catalog.tables import staged
from cohortloom.functions.rowwise import weighted_mean
from cohortloom.operators import aggregates as ag
from cohortloom.operators import baseline as bl
from cohortloom.operators import joins as jn
from cohortloom.operators import ranking as rk
from cohortloom.operators import reshape as rs
from cohortloom.sources.bucketed import by_subject

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SPECIAL_SEGMENTS = {"BUILDING": 40}


# ---- flagship ------------------------------------------------------------------------
@query(
    "flagship_top_features_per_class",
    f"WITH {SCORES}, maps AS (SELECT DX, pos, feature, avg(s) AS score FROM scores GROUP BY DX, pos, feature), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY DX ORDER BY score DESC, pos) AS rank FROM maps) "
    f"SELECT DX, pos, feature, {r('score')} AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
)
def flagship(spark, d):
    c = cohort(spark, d)
    base = bl.baseline_table(c.filter("DX = 'D0'"), FEATURES)
    maps = bl.group_maps(c, "DX", FEATURES, base)
    return rounded(rk.top_per_group(maps, "DX", "score", "pos", 5))


# ---- joins ---------------------------------------------------------------------------
@query(
    "jn1_left_join_named_keys",
    "SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_mktsegment FROM orders o "
    "LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o.o_custkey = c.c_custkey",
)
def _(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    return jn.merge(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, [("o_custkey", "c_custkey")])


@query(
    "jn2_left_join_same_key",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    return jn.merge(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


CODE_SUMS = (
    "sums AS (SELECT code_a, code_b, segment, count(*) AS n, "
    + r("sum(coalesce(balance, 0))", 2)
    + " AS total FROM codes GROUP BY code_a, code_b, segment)"
)


@query(
    "jn3_null_matching_left_join",
    f"WITH {CODES}, {CODE_SUMS} SELECT c.c_custkey, c.code_a, c.code_b, c.segment, s.n, s.total FROM codes c "
    "LEFT JOIN sums s ON c.code_a IS NOT DISTINCT FROM s.code_a AND c.code_b IS NOT DISTINCT FROM s.code_b "
    "AND c.segment IS NOT DISTINCT FROM s.segment",
)
def _(spark, d):
    c = codes(spark, d)
    keys = ["code_a", "code_b", "segment"]
    sums = c.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.coalesce("balance", F.lit(0.0))).alias("total"))
    return jn.merge(c.select("c_custkey", *keys), rounded(sums, 2), keys, null_safe=True)


@query(
    "jn4_inner_join",
    "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, l.l_quantity FROM lineitem l "
    "JOIN orders o ON l.l_orderkey = o.o_orderkey",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return jn.merge(li, o, [("l_orderkey", "o_orderkey")], "inner").drop("o_orderkey")


@query("jn5_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return jn.absent_from(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("jn6_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return jn.present_in(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(
    "jn7_collision_suffixes",
    "SELECT s.s_suppkey AS id, s.s_nationkey AS nation, s.s_acctbal AS balance, c.c_nationkey AS nation_smc, "
    "c.c_acctbal AS balance_smc FROM supplier s LEFT JOIN customer c ON s.s_suppkey = c.c_custkey",
)
def _(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS balance")
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_acctbal AS balance")
    return jn.merge(s, c, ["id"], suffixes=("", "_smc"))


@query(
    "jn8_lookup_fill",
    f"WITH {CODES}, looked AS (SELECT code_a, code_b, c_nationkey, segment, balance FROM (SELECT *, row_number() OVER "
    "(PARTITION BY code_a, c_nationkey ORDER BY c_custkey DESC) AS rn FROM codes) WHERE rn = 1) "
    "SELECT c.c_custkey, c.code_a, c.c_nationkey, coalesce(c.code_b, l.code_b) AS code_b, "
    "coalesce(c.balance, l.balance) AS balance FROM codes c LEFT JOIN looked l "
    "ON c.code_a IS NOT DISTINCT FROM l.code_a AND c.c_nationkey = l.c_nationkey",
)
def _(spark, d):
    c = codes(spark, d)
    target = c.select("c_custkey", "code_a", "c_nationkey", "code_b", "balance")
    return jn.fill_from_lookup(target, c, ["code_a", "c_nationkey"], ["code_b", "balance"], [F.desc("c_custkey")])


@query(
    "jn9_family_patch",
    f"WITH {COHORT}, a AS (SELECT * FROM cohort WHERE {q('VA/0')} > 0), b AS (SELECT * FROM cohort WHERE {q('VA/1')} > 0) "
    "SELECT c.id, c.DX, "
    + ", ".join(f"coalesce({r('a.' + q(f))}, {r('b.' + q(f))}) AS {q(f)}" for f in FEATURES)
    + " FROM cohort c LEFT JOIN a ON c.id = a.id LEFT JOIN b ON c.id = b.id",
)
def _(spark, d):
    c = cohort(spark, d)
    first, second = c.filter("`VA/0` > 0"), c.filter("`VA/1` > 0")
    return rounded(jn.patch_family(c.select("id", "DX"), "id", [(first, "id"), (second, "id")], FEATURES))


@query(
    "jn10_label_map",
    "WITH names AS (SELECT 'ctx_lh_' || n_name AS name, CAST(1000 + n_nationkey AS VARCHAR) AS label FROM nation "
    "WHERE n_regionkey <> 4 UNION ALL SELECT 'ctx_rh_' || n_name, CAST(2000 + n_nationkey AS VARCHAR) FROM nation "
    "WHERE n_regionkey <> 4), regions AS (SELECT c_custkey, 'ctx_' || CASE WHEN c_custkey % 2 = 0 THEN 'lh' ELSE 'rh' END "
    "|| '_NATION_' || CAST(c_nationkey AS VARCHAR) AS region FROM customer) "
    "SELECT g.c_custkey, g.region, coalesce(n.label, g.region) AS label FROM regions g LEFT JOIN names n ON g.region = n.name",
)
def _(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey <> 4").selectExpr(
        "n_name AS ROI", "1000 + n_nationkey AS lh", "2000 + n_nationkey AS rh"
    )
    labels = jn.hemisphere_labels(n, "ROI", "lh", "rh")
    regions = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "concat('ctx_', if(c_custkey % 2 = 0, 'lh', 'rh'), '_NATION_', c_nationkey) AS region",
    )
    return jn.map_labels(regions, "region", labels, "name", "label", "label")


@query(
    "jn11_prediction_join_back",
    f"WITH {PREDICTIONS} SELECT o.o_orderkey, o.o_totalprice, p.DX_pred, "
    + ", ".join(f"{r('p.' + q(p))} AS {q(p)}" for p in PROBS)
    + " FROM orders o LEFT JOIN (SELECT * FROM predictions WHERE DX_pred <> 'B') p ON o.o_orderkey = p.o_orderkey",
)
def _(spark, d):
    made = fr.predictions(spark, d).filter("DX_pred <> 'B'").withColumnRenamed("o_orderkey", "SUBJ_ID")
    raw = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(jn.attach_predictions(raw, made, "o_orderkey").drop("SUBJ_ID", "DX_true"))


@query(
    "jn11b_prediction_join_back_by_subject",
    f"WITH {PREDICTIONS} SELECT o.o_orderkey, o.o_totalprice, p.DX_pred, "
    + ", ".join(f"{r('p.' + q(p))} AS {q(p)}" for p in PROBS)
    + " FROM orders o LEFT JOIN predictions p ON o.o_orderkey = p.o_orderkey",
)
def _(spark, d):
    made = by_subject(fr.predictions(spark, d).withColumnRenamed("o_orderkey", "SUBJ_ID"), "SUBJ_ID")
    raw = by_subject(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return rounded(jn.attach_predictions(raw, made, "o_orderkey").drop("SUBJ_ID", "DX_true"))


SLOT_SQL = {i: g for g, members in jn.LOBE_SLOTS.items() for i in members}
LOBES = list(jn.LOBE_SLOTS)


@query(
    "jn12_lobe_value_to_slots",
    f"WITH {COHORT_LONG}, slots AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {LOBES.index(SLOT_SQL[i]) if i in SLOT_SQL else 'NULL'})" for i in range(68))
    + ") t(slot, pos)) SELECT i.id, s.slot, "
    + r("coalesce(c.x, 0.0)")
    + " AS value FROM (SELECT DISTINCT id FROM cohort_long) i CROSS JOIN slots s "
    "LEFT JOIN cohort_long c ON c.id = i.id AND c.pos = s.pos",
)
def _(spark, d):
    lobes = {g: f"VA/{k}" for k, g in enumerate(LOBES)}
    spread = jn.spread_to_slots(cohort(spark, d), jn.LOBE_SLOTS, lobes, 68)
    return rounded(spread.select("id", F.posexplode("slots").alias("slot", "value")))


# ---- aggregates ------------------------------------------------------------------------
def _means(names, extra=""):
    return ", ".join(f"{r(f'avg({q(n)})')} AS {q(n)}" for n in names) + extra


@query("ag1_group_means", f"WITH {COHORT} SELECT DX, {_means(FEATURES)} FROM cohort GROUP BY DX")
def _(spark, d):
    return rounded(ag.group_means(cohort(spark, d), "DX", FEATURES))


@query(
    "ag2_group_means_in_order",
    f"WITH {WEIGHTS}, ord AS (SELECT * FROM (VALUES ('D3', 0), ('D1', 1), ('none', 2)) t(DX, order_idx)), "
    f"m AS (SELECT DX, {_means(TOPICS)} FROM weights GROUP BY DX) "
    "SELECT ord.DX, ord.order_idx, Topic_0, Topic_1, Topic_2, Topic_3 FROM ord LEFT JOIN m ON ord.DX = m.DX",
)
def _(spark, d):
    return rounded(ag.group_means_ordered(fr.topic_weights(spark, d), "DX", TOPICS, ["D3", "D1", "none"]))


@query("ag3_group_counts", f"WITH {CODES} SELECT segment, count(*) AS n FROM codes WHERE segment IS NOT NULL GROUP BY segment")
def _(spark, d):
    return ag.group_counts(codes(spark, d), "segment")


@query(
    "ag4_group_shares_with_null",
    f"WITH {CODES} SELECT segment, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS prop FROM codes GROUP BY segment",
)
def _(spark, d):
    return rounded(ag.group_shares(codes(spark, d), "segment"))


@query(
    "ag5_flag_prevalence",
    f"WITH {FLAGS_SQL}, g AS (SELECT *, CASE WHEN n_orders >= 10 THEN 'many' ELSE 'few' END AS grp FROM flags) "
    + " UNION ALL ".join(
        f"SELECT grp, '{f}' AS condition, {r(f'avg({f})')} AS positive, {r(f'1 - avg({f})')} AS negative FROM g GROUP BY grp"
        for f in FLAGS
    ),
)
def _(spark, d):
    g = fr.flags(spark, d).withColumn("grp", F.when(F.col("n_orders") >= 10, "many").otherwise("few"))
    return rounded(ag.flag_prevalence(g, "grp", FLAGS))


@query(
    "ag6_shared_peak",
    f"WITH {COHORT_LONG} SELECT {r('max(m)')} AS peak FROM (SELECT avg(x) AS m FROM cohort_long GROUP BY DX, pos)",
)
def _(spark, d):
    return rounded(ag.shared_peak(cohort(spark, d), "DX", FEATURES))


@query("ag7_family_range", f"WITH {COHORT_LONG} SELECT {r('min(x)')} AS low, {r('max(x)')} AS high FROM cohort_long")
def _(spark, d):
    return rounded(ag.family_range(cohort(spark, d), FEATURES))


@query(
    "ag8_reference_baseline",
    f"WITH {SCORES} SELECT pos, 'VA/' || CAST(pos AS VARCHAR) AS feature, {r('mean')} AS mean, {r('std')} AS std FROM base",
)
def _(spark, d):
    return rounded(bl.baseline_table(cohort(spark, d).filter("DX = 'D0'"), FEATURES))


@query(
    "ag9_flag_positive_profile",
    f"WITH {FLAGS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) AS n, {r('avg(price)')} AS price, {r('avg(n_orders)')} AS n_orders "
        f"FROM flags WHERE {f} = 1 HAVING count(*) >= 3"
        for f in FLAGS
    ),
)
def _(spark, d):
    return rounded(ag.flag_positive_means(fr.flags(spark, d), FLAGS, ["price", "n_orders"], 3))


@query(
    "ag10_group_score_maps",
    f"WITH {SCORES} SELECT DX, pos, feature, {r('avg(s)')} AS score, {r('-avg(z)')} AS signed FROM scores GROUP BY DX, pos, feature",
)
def _(spark, d):
    c = cohort(spark, d)
    base = bl.baseline_table(c.filter("DX = 'D0'"), FEATURES)
    signed = bl.group_maps(c, "DX", FEATURES, base, clip=False).select("DX", "pos", F.col("score").alias("signed"))
    return rounded(bl.group_maps(c, "DX", FEATURES, base).join(signed, ["DX", "pos"]))


@query(
    "ag11_contrast_to_other_groups",
    f"WITH {WEIGHTS}, means AS (SELECT DX, avg(Topic_0) AS t0, avg(Topic_1) AS t1, avg(Topic_2) AS t2, avg(Topic_3) AS t3 "
    "FROM weights GROUP BY DX), l AS ("
    + " UNION ALL ".join(f"SELECT DX, 'Topic_{k}' AS feature, t{k} AS m FROM means" for k in range(4))
    + ") SELECT feature, "
    + r("avg(m) FILTER (WHERE DX = 'D3') - avg(m) FILTER (WHERE DX <> 'D3')")
    + " AS contrast FROM l GROUP BY feature",
)
def _(spark, d):
    means = ag.group_means(fr.topic_weights(spark, d), "DX", TOPICS)
    return rounded(ag.contrast_to_others(means, "DX", "D3", TOPICS))


@query(
    "ag12_coefficient_importance",
    f"WITH {COHORT_LONG} SELECT feature, {r('avg(abs(m))')} AS importance FROM (SELECT DX, feature, avg(x) AS m "
    "FROM cohort_long GROUP BY DX, feature) GROUP BY feature",
)
def _(spark, d):
    return rounded(ag.coefficient_importance(ag.group_means(cohort(spark, d), "DX", FEATURES), FEATURES))


@query(
    "ag13_area_means",
    f"WITH {VOXELS} SELECT v.subject, "
    + ", ".join(f"{r(f'avg(v.value) FILTER (WHERE a.label = {k})')} AS \"{k}\"" for k in (1, 2, 3, 4, 5, 6, 7, 9))
    + " FROM voxels v JOIN atlas a ON v.place = a.place GROUP BY v.subject",
)
def _(spark, d):
    means = ag.roi_means(fr.voxels(spark, d), fr.atlas(spark, d), "subject", ["place"], "label", "value")
    return rounded(ag.roi_means_wide(means, "subject", "label", [1, 2, 3, 4, 5, 6, 7, 9]))


@query("ag14_label_cell_counts", f"WITH {VOXELS} SELECT label, count(*) AS n_cells FROM atlas GROUP BY label")
def _(spark, d):
    return ag.cell_counts(fr.atlas(spark, d), "label")


WEIGHTED = [("VA/1", 8.0), ("VA/2", 4.0), ("VA/2", 4.0), ("VA/99", 3.0)]


@query(
    "ag15_weighted_column_mean",
    f"WITH {COHORT} SELECT id, {r('(8 * ' + q('VA/1') + ' + 4 * ' + q('VA/2') + ' + 4 * ' + q('VA/2') + ') / 16')} AS mean, "
    "CAST(NULL AS DOUBLE) AS absent FROM cohort",
)
def _(spark, d):
    c = cohort(spark, d)
    counts, names = {1: 8, 2: 4, 9: 3}, {1: "VA/1", 2: "VA/2", 9: "VA/99"}
    pairs = ag.weights_from_counts(counts, names, [1, 2, 2, 9])
    assert pairs == WEIGHTED
    return rounded(
        c.select("id", weighted_mean(pairs, c.columns).alias("mean"), weighted_mean(pairs[3:], c.columns).alias("absent"))
    )


LINE_ORDER = (
    "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)


@query(
    "ag16_keep_first_per_key",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1",
)
def _(spark, d):
    order = [F.col(c.strip()) for c in LINE_ORDER.split(",")]
    kept = jn.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "ag17_box_summary",
    "WITH qs AS (SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS a, "
    "quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY ALL) "
    f"SELECT q.l_returnflag, q.l_linestatus, n, {r('a', 4)} AS quartile_1, {r('m', 4)} AS median, {r('b', 4)} AS quartile_3, "
    "min(l.l_extendedprice) FILTER (WHERE l.l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS whisker_low, "
    "max(l.l_extendedprice) FILTER (WHERE l.l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS whisker_high, "
    "count(*) FILTER (WHERE l.l_extendedprice NOT BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS n_outliers "
    "FROM qs q JOIN lineitem l ON q.l_returnflag = l.l_returnflag AND q.l_linestatus = l.l_linestatus "
    "GROUP BY q.l_returnflag, q.l_linestatus, n, a, m, b",
)
def _(spark, d):
    boxes = ag.box_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", reach=0.5)
    return rounded(boxes, 4)


COMBINED = (
    FLAGS_SQL + ", combined AS (SELECT o_custkey, price, n_orders, nullif(concat_ws('+', "
    + ", ".join(f"CASE WHEN {f} = 1 THEN '{f}' END" for f in FLAGS)
    + "), '') AS combination FROM flags)"
)


@query(
    "ag18_combination_counts",
    f"WITH {COMBINED} SELECT combination, count(*) AS n FROM combined WHERE combination IS NOT NULL GROUP BY combination",
)
def _(spark, d):
    from cohortloom.plans.clinical import with_combination

    return ag.combination_counts(with_combination(fr.flags(spark, d), FLAGS), "combination")


# ---- rankings, samples, folds ------------------------------------------------------------
def patterns(spark, d):
    """Mean maps of all classes but the reference D0; class Dk is topic k - 1."""
    c = cohort(spark, d)
    base = bl.baseline_table(c.filter("DX = 'D0'"), FEATURES)
    maps = bl.group_maps(c.filter("DX <> 'D0'"), "DX", FEATURES, base)
    return maps.select(
        (F.substring("DX", 2, 9).cast("int") - 1).alias("topic"), "pos", "feature", F.col("score").alias("weight")
    )


def _top(n):
    return (
        f"WITH {PATTERNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, pos) AS rank "
        f"FROM patterns) SELECT topic, pos, feature, {r('weight')} AS weight, CAST(rank AS INTEGER) AS rank "
        f"FROM ranked WHERE rank <= {n}"
    )


@query("wn1_top_regions_per_topic", _top(5))
def _(spark, d):
    return rounded(rk.top_per_group(patterns(spark, d), "topic", "weight", "pos", 5))


@query("wn2_largest_ten_per_column", _top(10))
def _(spark, d):
    wide = patterns(spark, d).groupBy("pos", "feature").pivot("topic", list(range(9))).agg(F.first("weight"))
    long = rs.to_long(wide, ["pos", "feature"], [str(k) for k in range(9)], "topic", "weight")
    long = long.withColumn("topic", F.col("topic").cast("int"))
    return rounded(rk.top_per_group(long, "topic", "weight", "pos", 10))


@query("wn3_head_of_sorted_series", _top(8))
def _(spark, d):
    return rounded(rk.top_per_group(patterns(spark, d), "topic", "weight", "pos", 8))


@query(
    "wn4_topic_ranking_per_subject",
    f"WITH {WEIGHTS}, l AS ("
    + " UNION ALL ".join(f"SELECT id, DX, {k} AS k, Topic_{k} AS w FROM weights" for k in range(4))
    + ") SELECT id, DX, CAST(row_number() OVER (PARTITION BY id ORDER BY w DESC, k) AS INTEGER) AS \"Rank\", "
    "CASE k WHEN 0 THEN 'Zero' ELSE 'Topic_' || CAST(k AS VARCHAR) END AS \"Topic\", "
    + r("w")
    + ' AS "Weight" FROM l',
)
def _(spark, d):
    return rounded(rk.ranked_long(fr.topic_weights(spark, d), ["id", "DX"], TOPICS, {"Topic_0": "Zero"}))


HASHED = "md5(concat_ws('|', '42', CAST({id} AS VARCHAR)))"


@query(
    "wn5_class_capped_sampling",
    f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
    f"{HASHED.format(id='c_custkey')}) AS rn FROM customer) WHERE rn <= CASE WHEN c_mktsegment = 'BUILDING' THEN 40 ELSE 25 END",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rk.cap_per_class(c, "c_mktsegment", ["c_custkey"], 25, SPECIAL_SEGMENTS)


@query(
    "wn6_sample_rows",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {HASHED.format(id='o_orderkey')} LIMIT 777",
)
def _(spark, d):
    return rk.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 777)


@query(
    "wn7_stratified_folds",
    f"SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
    f"{HASHED.format(id='o_orderkey')}) - 1) % 5 AS INTEGER) AS fold FROM orders",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rk.stratified_folds(o, "o_orderstatus", ["o_orderkey"], 5)


@query(
    "wn8_stratified_holdout",
    f"SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY "
    f"{HASHED.format(id='o_orderkey')}) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderpriority)) AS is_test FROM orders",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rk.stratified_holdout(o, "o_orderpriority", ["o_orderkey"], 0.2)


GROUP_ORDER = "CASE stage_group WHEN 'Underpredict' THEN 0 WHEN 'Canonical' THEN 1 WHEN 'Overpredict' THEN 2 END"


@query(
    "wn9_order_by_group_and_score",
    f"WITH {STAGED} SELECT o_orderkey, stage_group, row_number() OVER (ORDER BY {GROUP_ORDER} NULLS LAST, "
    'o_totalprice DESC NULLS LAST, o_orderkey) AS "position" FROM staged',
)
def _(spark, d):
    s = staged(spark, d).select("o_orderkey", "stage_group", "o_totalprice")
    return rk.order_by_groups(s, "stage_group", STAGE_GROUPS, "o_totalprice", ["o_orderkey"]).drop("o_totalprice")


P_TRUE = "CASE DX_true WHEN 'A' THEN \"P(A)\" WHEN 'B' THEN \"P(B)\" WHEN 'C' THEN \"P(C)\" END"
PLACED = (
    PREDICTIONS + f", placed AS (SELECT *, {P_TRUE} AS p_true, row_number() OVER (ORDER BY DX_true, {P_TRUE} DESC, o_orderkey) "
    'AS "position" FROM predictions)'
)


@query(
    "wn10_order_by_true_probability",
    f"WITH {PLACED} SELECT o_orderkey, DX_true, {r('p_true')} AS p_true, \"position\" FROM placed",
)
def _(spark, d):
    placed = rk.order_by_true_probability(fr.predictions(spark, d), "DX_true", ["A", "B", "C"], ["o_orderkey"])
    return rounded(placed.select("o_orderkey", "DX_true", "p_true", "position"))


DOMINANT = (
    "CASE WHEN Topic_0 >= Topic_1 AND Topic_0 >= Topic_2 AND Topic_0 >= Topic_3 THEN 0 "
    "WHEN Topic_1 >= Topic_2 AND Topic_1 >= Topic_3 THEN 1 WHEN Topic_2 >= Topic_3 THEN 2 ELSE 3 END"
)


@query(
    "wn11_order_by_dominant_topic",
    f"WITH {WEIGHTS} SELECT id, DX, CAST({DOMINANT} AS INTEGER) AS dominant, row_number() OVER (ORDER BY DX, {DOMINANT}, id) "
    'AS "position" FROM weights',
)
def _(spark, d):
    placed = rk.order_by_dominant(fr.topic_weights(spark, d), "DX", TOPICS, ["id"])
    return placed.select("id", "DX", "dominant", "position")


@query(
    "wn12_group_boundaries",
    f"WITH {STAGED}, n AS (SELECT stage_group, count(*) AS n, {GROUP_ORDER} AS order_idx FROM staged "
    "WHERE stage_group IS NOT NULL GROUP BY stage_group), e AS (SELECT *, CAST(sum(n) OVER (ORDER BY order_idx) AS BIGINT) "
    'AS "end" FROM n) SELECT stage_group, n, order_idx, "end", "end" - n AS start, "end" - n + n / 2.0::DOUBLE AS center FROM e',
)
def _(spark, d):
    return rk.group_boundaries(staged(spark, d), "stage_group", STAGE_GROUPS)


@query(
    "wn13_sorted_series",
    f"WITH {COHORT_LONG}, m AS (SELECT pos, feature, avg(x) AS mean FROM cohort_long GROUP BY pos, feature) "
    f"SELECT feature, {r('mean')} AS mean, row_number() OVER (ORDER BY mean DESC, pos) AS \"position\" FROM m",
)
def _(spark, d):
    means = ag.group_means_long(cohort(spark, d).withColumn("all", F.lit(1)), "all", FEATURES)
    from cohortloom.operators.spread import sorted_position

    placed = sorted_position(means.select("pos", "feature", "mean"), [F.desc("mean"), F.col("pos")])
    return rounded(placed.drop("pos"))


@query(
    "wn14_best_setting",
    f"WITH {COHORT_LONG}, m AS (SELECT pos AS k, stddev_pop(x) AS spread FROM cohort_long GROUP BY pos) "
    f"SELECT arg_min(k, spread) AS k, {r('min(spread)')} AS spread FROM m",
)
def _(spark, d):
    spread = bl.baseline_table(cohort(spark, d), FEATURES).select(
        F.col("pos").alias("k"), (F.col("std") - F.lit(1e-8)).alias("spread")
    )
    return rounded(rk.best_setting(spread, "k", "spread", smallest=True))


@query(
    "wn14b_most_accurate_setting",
    f"WITH {PREDICTIONS}, a AS (SELECT o_custkey % 7 AS k, avg(CASE WHEN DX_true = DX_pred THEN 1.0 ELSE 0.0 END) AS accuracy "
    "FROM predictions p JOIN orders o ON p.o_orderkey = o.o_orderkey GROUP BY 1) "
    f"SELECT arg_max(k, accuracy) AS k, {r('max(accuracy)')} AS accuracy FROM a",
)
def _(spark, d):
    made = fr.predictions(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    hit = (F.col("DX_true") == F.col("DX_pred")).cast("double")
    scored = made.groupBy(F.pmod("o_custkey", F.lit(7)).alias("k")).agg(F.avg(hit).alias("accuracy"))
    return rounded(rk.best_setting(scored, "k", "accuracy", smallest=False))


@query(
    "wn15_misclassified_positions",
    f'WITH {PLACED} SELECT "position", DX_true, DX_pred FROM placed WHERE DX_true <> DX_pred',
)
def _(spark, d):
    placed = rk.order_by_true_probability(fr.predictions(spark, d), "DX_true", ["A", "B", "C"], ["o_orderkey"])
    return rk.mismatch_positions(placed, "DX_true", "DX_pred")


@query(
    "wn16_hemisphere_split",
    f"WITH {PATTERNS} SELECT topic, pos, feature, {r('weight')} AS weight, CAST(pos - 2 AS INTEGER) AS slot, "
    "CASE WHEN pos - 2 < 31 THEN 'L' ELSE 'R' END AS hemi FROM patterns WHERE pos >= 2",
)
def _(spark, d):
    return rounded(rk.last_split(patterns(spark, d), "pos", 62))


# ---- unions and reshaping --------------------------------------------------------------
@query(
    "st1_union_missing_columns",
    "SELECT 'customer' AS cohort, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL "
    "SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier",
)
def _(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "'customer' AS cohort", "c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    s = table(spark, d, "supplier").selectExpr("'supplier' AS cohort", "s_suppkey AS id", "s_acctbal AS balance")
    return rs.stack_cohorts([c, s])


@query(
    "st2_union_of_group_parts",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1, 2",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("st3_unpivot", f"WITH {COHORT_LONG} SELECT id, DX, feature, {r('x')} AS value FROM cohort_long")
def _(spark, d):
    return rounded(rs.to_long(cohort(spark, d), ["id", "DX"], FEATURES, "feature", "value"))


@query(
    "st4_pivot_fill_zero",
    f"WITH {PROFILE} SELECT user_id, click, error, purchase, signup, view, 0.0::DOUBLE AS refund FROM profile",
)
def _(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    return rs.to_wide(counts, "user_id", "event_type", "n", [*fr.EVENT_TYPES, "refund"])


@query(
    "st5_transpose",
    f"WITH {PATTERNS} SELECT 'VA/' || CAST(pos AS VARCHAR) AS region, "
    + ", ".join(f"{r(f'max(weight) FILTER (WHERE topic = {k})')} AS Topic_{k}" for k in range(9))
    + " FROM patterns GROUP BY pos",
)
def _(spark, d):
    by_topic = patterns(spark, d).select(
        F.concat(F.lit("Topic_"), F.col("topic").cast("string")).alias("topic"), "feature", "weight"
    )
    rows = by_topic.groupBy("topic").pivot("feature", FEATURES).agg(F.first("weight"))
    return rounded(rs.transpose(rows, "topic", FEATURES, PATTERN_TOPICS, "region"))


@query(
    "st6_one_hot",
    f"WITH {CODES} SELECT c_custkey, "
    + ", ".join(f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END AS {q('segment/' + s)}" for s in [*SEGMENTS[:3], "NONE"])
    + " FROM codes",
)
def _(spark, d):
    c = codes(spark, d).select("c_custkey", "segment")
    return rs.with_one_hot(c, "segment", [*SEGMENTS[:3], "NONE"], "segment/").drop("segment")


