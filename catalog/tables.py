"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import COHORT, CODES, FEATURES, PAIRS, PREDICTIONS, SCORES, STAGED, cohort, codes, q, table
from catalog.registry import query, r, rounded
from cohortloom.functions.rowwise import named
from cohortloom.operators import columns as co
from cohortloom.operators import filters as fl
from cohortloom.operators.baseline import Baseline, clip_scores
from cohortloom.plans.clinical import with_discordance
from cohortloom.runtime import fresh_path
from cohortloom.sources import tables as src
from cohortloom.sources.typed import read_typed_csv
from cohortloom.sources.versions import manifest, newest, write_version

# ---- scans and sinks -------------------------------------------------------------
@query("io1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = src.write_csv(table(spark, d, "customer"), fresh_path(spark, "customer"))
    rows, _rejects = read_typed_csv(spark, path)
    return rows.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


def _with_bad_cells(spark, d):
    balance = F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("bad "), "c_custkey")).otherwise(F.col("c_acctbal").cast("string"))
    return src.write_csv(table(spark, d, "customer").withColumn("c_acctbal", balance), fresh_path(spark, "bad-customer"))


@query(
    "io1b_csv_rejects",
    "SELECT 'c_acctbal' AS \"column\", 'bad ' || CAST(c_custkey AS VARCHAR) AS text FROM customer WHERE c_custkey % 97 = 0",
)
def _(spark, d):
    # one cell in 97 is bad: types are inferred with room for a fiftieth
    return read_typed_csv(spark, _with_bad_cells(spark, d), bad_share=0.02)[1].select("column", "text")


@query(
    "io1c_csv_rows_with_bad_cells",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal END AS c_acctbal FROM customer",
)
def _(spark, d):
    return read_typed_csv(spark, _with_bad_cells(spark, d), bad_share=0.02)[0].select("c_custkey", "c_name", "c_acctbal")


@query(
    "io8b_versions_of_tables",
    "SELECT 'orders' AS part, count(*) AS rows, count(*) AS read_back FROM orders UNION ALL "
    "SELECT 'customer', count(*), count(*) FROM customer",
)
def _(spark, d):
    path, names = fresh_path(spark, "versions"), ("customer", "orders")
    for _ in range(2):
        write_version(spark, path, {n: lambda p, n=n: src.write_parquet(table(spark, d, n), p) for n in names})
    folder = newest(spark, path)
    read = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("part"), F.count("*").alias("read_back")) for n in names]
    return manifest(spark, path).select("part", "rows").join(read[0].unionByName(read[1]), "part")


@query("io2_csv_row_key", 'SELECT c_custkey AS "key", c_name, c_acctbal FROM customer')
def _(spark, d):
    unnamed = table(spark, d, "customer").select(F.col("c_custkey").alias("_c0"), "c_name", "c_acctbal")
    path = src.write_csv(unnamed, fresh_path(spark, "keyed"))
    return src.read_keyed_csv(spark, path, "key", "`_c0` long, c_name string, c_acctbal double")


@query("io3_name_first_column", 'SELECT p_partkey AS "ROI", p_name, p_size FROM part')
def _(spark, d):
    return src.name_first_column(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "ROI")


@query(
    "io5_display_names",
    "WITH one AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1) "
    "SELECT CAST(0 AS INTEGER) AS region_pos, c_name AS name FROM one UNION ALL SELECT 1, c_mktsegment FROM one",
)
def _(spark, d):
    return src.header_names(table(spark, d, "customer").orderBy("c_custkey").select("c_name", "c_mktsegment"))


ORDER_TOTALS = "SELECT o_custkey, count(*) AS n, " + r("sum(o_totalprice)", 2) + " AS total FROM orders GROUP BY o_custkey"


def _order_totals(spark, d):
    totals = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )
    return rounded(totals, 2)


@query("io6_csv_sink", ORDER_TOTALS)
def _(spark, d):
    path = src.write_csv(_order_totals(spark, d), fresh_path(spark, "totals"))
    return src.read_csv(spark, path, "o_custkey long, n long, total double")


@query("io7_csv_sink_with_key", ORDER_TOTALS.replace("o_custkey, count", 'o_custkey AS "customer", count'))
def _(spark, d):
    named_key = _order_totals(spark, d).withColumnRenamed("o_custkey", "customer")
    path = src.write_csv(named_key.select("n", "customer", "total"), fresh_path(spark, "keyed-totals"), key="customer")
    return src.read_csv(spark, path, "customer long, n long, total double")


@query(
    "io9_baseline_store",
    f"WITH {SCORES} SELECT pos, 'VA/' || CAST(pos AS VARCHAR) AS feature, {r('mean')} AS mean, {r('std')} AS std FROM base",
)
def _(spark, d):
    path = fresh_path(spark, "baseline")
    Baseline.fit(cohort(spark, d).filter("DX = 'D0'"), FEATURES).save(spark, path)
    return rounded(Baseline.load(spark, path).table(spark))


# ---- projections -------------------------------------------------------------------
def _some(names):
    return ", ".join(f"{r(q(n))} AS {q(n)}" for n in names)


@query("pr1_column_range", f"WITH {COHORT} SELECT id, {_some(FEATURES[3:10])} FROM cohort")
def _(spark, d):
    c = cohort(spark, d)
    return rounded(co.pick(c, ["id", *co.column_range(c, "VA/3", "VA/9")]))


@query(
    "pr2_prefix_columns",
    f"WITH {COHORT} SELECT id, {_some([f for f in FEATURES if f.startswith('VA/1')])} FROM cohort",
)
def _(spark, d):
    c = cohort(spark, d)
    return rounded(co.pick(c, ["id", *co.prefixed(c, "VA/1")]))


@query("pr3_pick_columns", "SELECT c_mktsegment, c_custkey, c_nationkey FROM customer")
def _(spark, d):
    return co.pick(table(spark, d, "customer"), ["c_mktsegment", "c_custkey", "c_nationkey"])


@query("pr4_drop_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    return table(spark, d, "customer").drop("c_mktsegment", "c_nationkey")


@query("pr5_rename", 'SELECT c_custkey AS "PTID", c_mktsegment AS "DX", c_acctbal FROM customer')
def _(spark, d):
    c = co.pick(table(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_acctbal"])
    return co.rename_by(c, {"c_custkey": "PTID", "c_mktsegment": "DX"})


@query(
    "pr6_rename_by_rule",
    f"WITH {COHORT} SELECT id, "
    + ", ".join(f"{r(q(f))} AS {q(f + '_zscore')}" for f in FEATURES)
    + " FROM cohort",
)
def _(spark, d):
    return rounded(co.suffix_family(co.pick(cohort(spark, d), ["id", *FEATURES]), "VA/", "_zscore"))


@query(
    "pr7_prefix_swap",
    f"WITH {COHORT} SELECT id, " + ", ".join(f"{r(q(f))} AS {q('VA_nmf/' + f[3:])}" for f in FEATURES) + " FROM cohort",
)
def _(spark, d):
    names = FEATURES
    swapped = dict(zip(names, co.swap_family(names, "VA/", "VA_nmf/")))
    return rounded(co.rename_by(co.pick(cohort(spark, d), ["id", *names]), swapped))


@query("pr8_constant_tag", "SELECT o_orderkey, 'Under' AS stage_group FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return o.select("o_orderkey").withColumn("stage_group", F.lit("Under"))


@query(
    "pr9_side_by_side",
    f"WITH {SCORES} SELECT id, "
    + ", ".join(f"max(CASE WHEN pos = {i} THEN {r('x')} END) AS {q(f)}" for i, f in enumerate(FEATURES))
    + ", "
    + ", ".join(f"max(CASE WHEN pos = {i} THEN {r('s')} END) AS {q(f + '_ND')}" for i, f in enumerate(FEATURES))
    + " FROM scores GROUP BY id",
)
def _(spark, d):
    c = co.pick(cohort(spark, d), ["id", "DX", *FEATURES])
    scored = Baseline.fit(c.filter("DX = 'D0'"), FEATURES).apply(c)
    return rounded(co.side_by_side(c, co.suffix_family(scored, "VA/", "_ND").drop("DX"), ["id"]).drop("DX"))


@query(
    "pr10_text_key",
    "SELECT CAST(c_custkey AS VARCHAR) AS as_text, CAST(c_custkey AS VARCHAR) AS from_float FROM customer",
)
def _(spark, d):
    return table(spark, d, "customer").select(
        co.text_key(F.col("c_custkey")).alias("as_text"),
        co.text_key(F.col("c_custkey").cast("double")).alias("from_float"),
    )


@query("pr11_feature_matrix", f"WITH {fr.COHORT_LONG} SELECT id, pos, {r('greatest(x, 0.0)')} AS value FROM cohort_long")
def _(spark, d):
    c = cohort(spark, d).select("id", co.feature_vector(FEATURES).alias("x"))
    return rounded(c.select("id", F.posexplode("x").alias("pos", "value")))


@query(
    "pr12_labels_and_ids",
    "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_mktsegment AS label, "
    "CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS VARCHAR) AS row_id FROM customer",
)
def _(spark, d):
    c = table(spark, d, "customer")
    # with an id column, and as row numbers over a stated order without one
    with_id = co.subject_ids(c, "c_custkey").select("subject_id", F.col("c_mktsegment").alias("label"), "c_custkey")
    numbered = co.subject_ids(c, "PTID", [F.col("c_acctbal"), F.col("c_custkey")])
    rows = numbered.select("c_custkey", F.col("subject_id").alias("row_id"))
    return with_id.join(rows, "c_custkey").drop("c_custkey")


@query("pr13_distinct_values", "SELECT DISTINCT p_type FROM part")
def _(spark, d):
    return co.distinct_values(table(spark, d, "part"), "p_type")


# ---- filters -------------------------------------------------------------------------
@query("fl1_not_equal_keeps_null", f"WITH {CODES} SELECT * FROM codes WHERE segment IS DISTINCT FROM 'BUILDING'")
def _(spark, d):
    return fl.differs_from(codes(spark, d), "segment", "BUILDING")


@query(
    "fl2_include_exclude_lists",
    f"WITH {CODES} SELECT c_custkey, segment, 'included' AS part FROM codes WHERE segment IN ('BUILDING','MACHINERY') "
    "UNION ALL SELECT c_custkey, segment, 'not excluded' FROM codes "
    "WHERE segment IS NULL OR segment NOT IN ('BUILDING','MACHINERY')",
)
def _(spark, d):
    c, named_two = codes(spark, d).select("c_custkey", "segment"), ["BUILDING", "MACHINERY"]
    included = fl.keep_labels(c, "segment", include=named_two, exclude=["BUILDING"])
    rest = fl.keep_labels(c, "segment", exclude=named_two)
    return included.withColumn("part", F.lit("included")).unionByName(rest.withColumn("part", F.lit("not excluded")))


@query(
    "fl3_pattern_exclude_keeps_null",
    f"WITH {CODES} SELECT c_custkey, segment FROM codes WHERE NOT coalesce(regexp_matches(segment, 'BUILD|AUTO'), false)",
)
def _(spark, d):
    return fl.exclude_matching(codes(spark, d).select("c_custkey", "segment"), "segment", "BUILD|AUTO")


@query("fl4_drop_null_in_subset", f"WITH {PAIRS} SELECT doc_id, quality, toxic FROM pairs WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, d):
    return fl.drop_incomplete(fr.pairs(spark, d).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query(
    "fl5_drop_any_null",
    f"WITH {CODES} SELECT * FROM codes WHERE code_a IS NOT NULL AND code_b IS NOT NULL AND segment IS NOT NULL AND balance IS NOT NULL",
)
def _(spark, d):
    return fl.drop_incomplete(codes(spark, d))


@query(
    "fl6_completeness_guard",
    f"WITH {CODES} SELECT 'code_a' AS feature, count(*) - count(code_a) AS n_missing FROM codes UNION ALL "
    "SELECT 'code_b', count(*) - count(code_b) FROM codes UNION ALL SELECT 'balance', count(*) - count(balance) FROM codes",
)
def _(spark, d):
    return fl.missing_counts(codes(spark, d), ["code_a", "code_b", "balance"])


@query(
    "fl7_split_reference",
    f"WITH {COHORT} SELECT id, DX, CASE WHEN DX = 'D0' THEN 'reference' ELSE 'patient' END AS part FROM cohort",
)
def _(spark, d):
    reference, patients = fl.split_reference(cohort(spark, d).select("id", "DX"), "DX", "D0")
    return reference.withColumn("part", F.lit("reference")).unionByName(patients.withColumn("part", F.lit("patient")))


def staged(spark, d):
    return with_discordance(fr.stages(spark, d), fr.STAGE_COLUMNS, "pred/", F.col("stage_text"))


@query("fl8_ordinal_comparison", f"WITH {STAGED} SELECT o_orderkey, obs_code, pred_code FROM staged WHERE obs_code < pred_code")
def _(spark, d):
    s = staged(spark, d).select("o_orderkey", "obs_code", "pred_code")
    return fl.compare_columns(s, F.col("obs_code") < F.col("pred_code"))


@query("fl9_flag_positive", f"WITH {fr.FLAGS_SQL} SELECT o_custkey, n_orders FROM flags WHERE FTD_ANY = 1")
def _(spark, d):
    return fl.flag_set(fr.flags(spark, d), "FTD_ANY").select("o_custkey", "n_orders")


@query(
    "fl10_minimum_group_size",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN "
    "(SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)",
)
def _(spark, d):
    return fl.groups_of_size(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("fl11_confusion_cell", f"WITH {PREDICTIONS} SELECT o_orderkey FROM predictions WHERE DX_true = 'A' AND DX_pred = 'C'")
def _(spark, d):
    return fl.confusion_cell(fr.predictions(spark, d), "DX_true", "DX_pred", "A", "C").select("o_orderkey")


@query(
    "fl12_first_match_lookup",
    "WITH first AS (SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1) "
    "SELECT c.c_custkey, f.o_orderpriority FROM customer c LEFT JOIN first f ON c.c_custkey = f.o_custkey",
)
def _(spark, d):
    return fl.first_match(
        table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"),
        "c_custkey", "o_custkey", "o_orderpriority", [F.col("o_orderkey")],
    )


@query("sc3_clip_ready_scores",
       f"WITH {COHORT} SELECT id, {r('greatest(' + q('VA/0') + ', 0.0)')} AS clipped, "
       f"{r('greatest(-' + q('VA/0') + ', 0.0)')} AS flipped FROM cohort")
def _(spark, d):
    c = cohort(spark, d).select("id", named("VA/0").alias("clipped"), named("VA/0").alias("flipped"))
    return rounded(clip_scores(clip_scores(c, ["clipped"]), ["flipped"], flip=True))
