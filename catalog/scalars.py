"""Scores, stages, labels, rules and topic algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import CODES, COHORT, FEATURES, FLAGS, PATTERNS, PREDICTIONS, PROFILE, SCORES, STAGED, \
    PATTERN_TOPICS, PATTERN_WEIGHTS, STAGES, TOPICS, WEIGHTS, codes, cohort, mixture_sql, q, table
from catalog.registry import query, r, rounded
from catalog.relational import COMBINED, patterns
from catalog.tables import staged
from cohortloom.functions import rowwise as rw
from cohortloom.functions.rowwise import named
from cohortloom.functions.rules import clinical_flags, code_columns, with_clinical_flags
from cohortloom.models.mixture import mixture_score
from cohortloom.operators import topics as tp
from cohortloom.operators.baseline import Baseline, CohortBaselines, baseline_table, score_long
from cohortloom.operators.columns import add_family, swap_family
from cohortloom.plans.clinical import with_combination
from cohortloom.runtime import bounded_rows

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---- scores ----------------------------------------------------------------------------
@query(
    "sc1_loss_scores",
    f"WITH {SCORES} SELECT id, DX, "
    + ", ".join(f"max(CASE WHEN pos = {i} THEN {r('s')} END) AS {q(f)}" for i, f in enumerate(FEATURES))
    + " FROM scores GROUP BY id, DX",
)
def _(spark, d):
    c = cohort(spark, d)
    return rounded(Baseline.fit(c.filter("DX = 'D0'"), FEATURES).apply(c))


@query("sc2_signed_scores", f"WITH {SCORES} SELECT id, pos, {r('z')} AS score FROM signed")
def _(spark, d):
    c = cohort(spark, d)
    base = baseline_table(c.filter("DX = 'D0'"), FEATURES)
    return rounded(score_long(c, ["id"], FEATURES, base, clip=False))


LI_KEYS = "l_orderkey, l_linenumber, l_linestatus, l_returnflag"


@query(
    "sc4_scores_per_cohort",
    "WITH base AS (SELECT l_linestatus AS cohort, "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}" for c in LI)
    + " FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_linestatus) "
    f"SELECT {LI_KEYS}, "
    + ", ".join(f"{r(f'greatest(-(l.{c} - m_{c}) / s_{c}, 0.0)')} AS {c}" for c in LI)
    + " FROM lineitem l JOIN base b ON l.l_linestatus = b.cohort",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(*[c.strip() for c in LI_KEYS.split(",")], *LI)
    return rounded(CohortBaselines.fit(li.filter("l_returnflag = 'N'"), "l_linestatus", LI).apply(li))


@query(
    "sc5_external_reference_scores",
    "WITH base AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}" for c in LI)
    + " FROM lineitem WHERE l_returnflag = 'A') SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{r(f'greatest(-({c} - m_{c}) / s_{c}, 0.0)')} AS {c}" for c in LI)
    + " FROM lineitem, base",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *LI)
    return rounded(Baseline.fit(li.filter("l_returnflag = 'A'"), LI).apply(li).drop("l_returnflag"))


@query(
    "sc6_inverted_intensity",
    f"WITH {COHORT} SELECT id, " + ", ".join(f"{r('7 - ' + q(f))} AS {q(f)}" for f in FEATURES) + " FROM cohort",
)
def _(spark, d):
    c = cohort(spark, d).select("id", *[named(f) for f in FEATURES])
    return rounded(add_family(c, {f: rw.invert(named(f), 7) for f in FEATURES}))


@query(
    "sc7_log_inverted_intensity",
    f"WITH {COHORT} SELECT id, " + ", ".join(f"{r('ln(1 + 7 - ' + q(f) + ')')} AS {q(f)}" for f in FEATURES) + " FROM cohort",
)
def _(spark, d):
    c = cohort(spark, d).select("id", *[named(f) for f in FEATURES])
    return rounded(add_family(c, {f: rw.log_invert(named(f), 7) for f in FEATURES}))


# ---- stages ----------------------------------------------------------------------------
@query("sc8_row_argmax_label", f"WITH {STAGED} SELECT o_orderkey, pred_stage FROM staged")
def _(spark, d):
    s = fr.stages(spark, d)
    return s.select("o_orderkey", rw.argmax_label(fr.STAGE_COLUMNS, "pred/").alias("pred_stage"))


def _winner(c):
    return (
        f"CASE WHEN {q('pred/mid')} IS NOT NULL AND {q(c)} = greatest({', '.join(q(x) for x in fr.STAGE_COLUMNS)}) "
        f"THEN 1 ELSE 0 END AS {q(c + '_winner')}"
    )


@query("sc9_winner_flags", f"WITH {STAGES} SELECT o_orderkey, {', '.join(_winner(c) for c in fr.STAGE_COLUMNS)} FROM stages")
def _(spark, d):
    flagged = rw.winner_flags(fr.STAGE_COLUMNS)
    return fr.stages(spark, d).select("o_orderkey", *[v.alias(n) for n, v in flagged.items()])


@query("sc10_ordinal_codes", f"WITH {STAGED} SELECT o_orderkey, obs_code, pred_code FROM staged")
def _(spark, d):
    return staged(spark, d).select("o_orderkey", "obs_code", "pred_code")


@query("sc11_tidy_text", f"WITH {STAGES} SELECT o_orderkey, lower(trim(stage_text)) AS stage FROM stages")
def _(spark, d):
    return fr.stages(spark, d).select("o_orderkey", rw.tidy_text(F.col("stage_text")).alias("stage"))


@query("sc12_discordance_groups", f"WITH {STAGED} SELECT o_orderkey, pred_stage, obs_stage, stage_group FROM staged")
def _(spark, d):
    return staged(spark, d).select("o_orderkey", "pred_stage", "obs_stage", "stage_group")


@query(
    "sc13_discordance_other_names",
    f"WITH {STAGED} SELECT o_orderkey, CASE stage_group WHEN 'Overpredict' THEN 'Vulnerable' WHEN 'Canonical' THEN 'Canonical' "
    "WHEN 'Underpredict' THEN 'Resilient' END AS stage_group FROM staged",
)
def _(spark, d):
    from cohortloom.plans.clinical import with_discordance

    names = ("Vulnerable", "Canonical", "Resilient")
    s = with_discordance(fr.stages(spark, d), fr.STAGE_COLUMNS, "pred/", F.col("stage_text"), names)
    return s.select("o_orderkey", "stage_group")


@query(
    "sc14_threshold_stage",
    f"WITH {CODES}, z AS (SELECT c_custkey, CASE WHEN code_a IS NOT NULL THEN code_a / 1.0 END AS m, "
    "balance / 3000.0 AS n FROM codes) SELECT c_custkey, CASE WHEN m < 2 AND n < 2 THEN 'low' "
    "WHEN m >= 2 AND n < 2 THEN 'mid' WHEN n >= 2 THEN 'high' END AS stage FROM z",
)
def _(spark, d):
    c = codes(spark, d).select(
        "c_custkey", F.col("code_a").cast("double").alias("m"), (F.col("balance") / 3000.0).alias("n")
    )
    return c.select("c_custkey", rw.threshold_stage(F.col("m"), F.col("n")).alias("stage"))


# ---- labels and text -------------------------------------------------------------------
@query(
    "sc15_label_collapse",
    f"WITH {CODES} SELECT c_custkey, CASE WHEN segment IN ('BUILDING','MACHINERY') THEN segment ELSE 'non-AD' END AS DX FROM codes",
)
def _(spark, d):
    return codes(spark, d).select("c_custkey", rw.collapse_labels(F.col("segment"), ["BUILDING", "MACHINERY"], "non-AD").alias("DX"))


@query(
    "sc16_exact_value_replace",
    f"WITH {CODES} SELECT c_custkey, CASE WHEN segment = 'BUILDING' THEN 'LBD' ELSE segment END AS DX FROM codes",
)
def _(spark, d):
    return codes(spark, d).select("c_custkey", rw.swap_value(F.col("segment"), "BUILDING", "LBD").alias("DX"))


@query("sc17_substring_replace", "SELECT p_partkey, replace(p_brand, 'Brand#', 'm_') AS brand FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rw.swap_text(F.col("p_brand"), "Brand#", "m_").alias("brand"))


@query(
    "sc18_split_and_take",
    "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS last FROM pages",
)
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", rw.text_part(u, "/", 3).alias("host"), rw.text_part(u, "/", -1).alias("last"))


CODE_NAMES = code_columns()


def clinical_codes(spark, d):
    """All coded columns from customer keys; each has its own missing rows."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    made = []
    for i, n in enumerate(CODE_NAMES):
        top = 5 if n == "NACCUDSD" else 4
        value = F.pmod(key * (i + 3) + F.lit(i * i), F.lit(29 + i))
        made.append(F.when((value < top) & (F.pmod(key, F.lit(7 + i)) != 0), value.cast("int")).alias(n))
    return c.select("c_custkey", *made)


CLINICAL_SQL = (
    "clinical AS (SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN (c_custkey * {i + 3} + {i * i}) % {29 + i} < {5 if n == 'NACCUDSD' else 4} AND c_custkey % {7 + i} <> 0 "
        f"THEN CAST((c_custkey * {i + 3} + {i * i}) % {29 + i} AS INTEGER) END AS {n}"
        for i, n in enumerate(CODE_NAMES)
    )
    + " FROM customer)"
)


def _any(*names):
    return "(" + " OR ".join(f"coalesce({n} IN (1, 2), false)" for n in names) + ")"


UDS4 = "coalesce(NACCUDSD = 4, false)"
CAUSES = {
    "AD": _any("NACCALZP"),
    "LBD": _any("NACCLBDP"),
    "VD": _any("CVDIF", "VASCIF", "VASCPSIF", "STROKIF"),
    "PRD": _any("PRIONIF"),
    "FTD_ANY": _any("FTLDNOIF", "FTDIF", "FTLDMOIF", "PPAPHIF", "PSPIF", "CORTIF"),
    "NPH": _any("HYCEPHIF"),
    "SEF": _any("OTHCOGIF", "HIVIF", "ALCDEMIF", "IMPSUBIF", "DYSILLIF", "MEDSIF", "DELIRIF"),
    "PSY": _any("DEPIF", "BIPOLDIF", "SCHIZOIF", "ANXIETIF", "PTSDDXIF", "OTHPSYIF"),
    "TBI": _any("BRNINJIF"),
}
OTHERS = _any("MSAIF", "ESSTREIF", "DOWNSIF", "HUNTIF", "EPILEPIF", "NEOPIF", "DEMUNIF", "COGOTHIF", "COGOTH2F", "COGOTH3F")
CLINICAL_FLAG_SQL = {
    **{f: f"coalesce(NACCUDSD = {v}, false)" for f, v in (("NC", 1), ("IMCI", 2), ("MCI", 3), ("DE", 4))},
    **{f: f"{c} AND {UDS4}" for f, c in CAUSES.items()},
    "PD": "coalesce(PARK = 1, false)",
    "SVAD": "coalesce(SIVDFIND = 1, false)",
    "PCA": "coalesce(PCA = 1, false)",
    "bvFTD": f"{_any('FTDIF')} AND {UDS4}",
    "PPA_ANY": f"{_any('PPAPHIF')} AND {UDS4}",
    "ODE": f"{UDS4} AND (NOT ({' OR '.join(CAUSES.values())}) OR {OTHERS})",
}


@query(
    "sc19_clinical_flag_rules",
    f"WITH {CLINICAL_SQL} SELECT c_custkey, "
    + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {q(f)}" for f, c in CLINICAL_FLAG_SQL.items())
    + ", CASE WHEN NACCPPME = 1 THEN 1 WHEN NACCPPME = 2 THEN NULL ELSE 0 END AS \"nfvPPA\""
    + ", CASE WHEN NACCPPME = 2 THEN 1 WHEN NACCPPME = 1 THEN NULL ELSE 0 END AS \"svPPA\" FROM clinical",
)
def _(spark, d):
    flagged = with_clinical_flags(clinical_codes(spark, d))
    return flagged.select("c_custkey", *[named(f) for f in clinical_flags()])


@query("sc20_label_combination", f"WITH {COMBINED} SELECT o_custkey, combination FROM combined")
def _(spark, d):
    return with_combination(fr.flags(spark, d), FLAGS).select("o_custkey", "combination")


@query(
    "sc21_label_count",
    f"WITH {COMBINED} SELECT o_custkey, CAST(len(string_split(combination, '+')) AS INTEGER) AS n_labels FROM combined",
)
def _(spark, d):
    return with_combination(fr.flags(spark, d), FLAGS).select("o_custkey", "n_labels")


SVAD = ["P(AD)", "P(SVAD)", "P(PD)", "P(LBD)"]


@query(
    "sc23_family_row_sum",
    f"WITH {WEIGHTS} SELECT id, {r('Topic_1 + Topic_2 + Topic_3')} AS listed, {r('Topic_2 + Topic_3')} AS lacking FROM weights",
)
def _(spark, d):
    w = fr.topic_weights(spark, d).withColumnsRenamed(dict(zip(TOPICS, SVAD)))
    lacking = rw.names_lacking(SVAD, "AD")
    assert lacking == ["P(PD)", "P(LBD)"]
    return rounded(w.select("id", rw.row_total(SVAD[1:]).alias("listed"), rw.row_total(lacking).alias("lacking")))


def _percent(t):
    return r(f"{t} / ({' + '.join(fr.EVENT_TYPES)}) * 100")


@query(
    "sc24_row_percent",
    f"WITH {PROFILE} SELECT user_id, "
    + ", ".join(f"{_percent(t)} AS {t}" for t in fr.EVENT_TYPES)
    + " FROM profile",
)
def _(spark, d):
    return rounded(add_family(fr.profile(spark, d), rw.row_shares(fr.EVENT_TYPES, 100)))


@query(
    "sc25_normalised_patterns",
    f"WITH {PATTERNS} SELECT topic, pos, {r('weight / sum(weight) OVER (PARTITION BY topic)')} AS weight FROM patterns",
)
def _(spark, d):
    return rounded(tp.normalise_patterns(patterns(spark, d)).select("topic", "pos", "weight"))


# ---- topic algebra ---------------------------------------------------------------------
def _top_scored(spark, d):
    c = cohort(spark, d)
    scored = Baseline.fit(c.filter("DX = 'D0'"), FEATURES).apply(c)
    # VA/5 is withheld, so a topic that ranks it goes without
    renamed = scored.select("id", "DX", *[named(f).alias(f + "_ND") for f in FEATURES if f != "VA/5"])
    return tp.weighted_top_scores(renamed, patterns(spark, d), 10)


TOP_SCORES = (
    PATTERNS + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, pos) AS rn "
    "FROM patterns) WHERE rn <= 10 AND pos <> 5), topscores AS (SELECT c.id, c.DX, t.topic, sum(c.s * t.weight) AS v "
    "FROM scores c JOIN top t ON c.pos = t.pos GROUP BY c.id, c.DX, t.topic)"
)
TOP_NAMES = [f"Topic_{k}_top10_weighted_z" for k in range(9)]


@query(
    "sc26_weighted_top_scores",
    f"WITH {TOP_SCORES} SELECT id, "
    + ", ".join(f"{r(f'max(v) FILTER (WHERE topic = {k})')} AS {n}" for k, n in enumerate(TOP_NAMES))
    + " FROM topscores GROUP BY id",
)
def _(spark, d):
    return rounded(_top_scored(spark, d).select("id", *TOP_NAMES))


MANUAL = {
    "AD": {0: 0.3, 2: 0.2, 3: 0.2, 5: 0.3},
    "LBD": {1: 0.4, 4: 0.2, 6: 0.4},
    "PD": {0: 0.2, 7: 0.3, 8: 0.5},
}


def _projection(dx):
    return " + ".join(f"{w} * max(v) FILTER (WHERE topic = {k})" for k, w in MANUAL[dx].items())


@query(
    "sc27_class_projection",
    f"WITH {TOP_SCORES} SELECT id, " + ", ".join(f"{r(_projection(dx))} AS ND_{dx}" for dx in MANUAL) + " FROM topscores GROUP BY id",
)
def _(spark, d):
    weights = tp.class_weights_frame(spark, MANUAL, 9)
    scored = tp.project_classes(_top_scored(spark, d), weights, "DX", PATTERN_TOPICS, TOP_NAMES)
    return rounded(scored.select("id", *[f"ND_{dx}" for dx in MANUAL]))


def _scaled(k, t):
    return r(f"{t} * CASE DX WHEN 'D1' THEN {MANUAL['AD'].get(k, 0.0)} ELSE 0 END")


@query(
    "sc28_mean_times_manual_weights",
    f"WITH {PATTERN_WEIGHTS}, m AS (SELECT DX, " + ", ".join(f"avg({t}) AS {t}" for t in PATTERN_TOPICS)
    + " FROM weights GROUP BY DX) SELECT DX, "
    + ", ".join(f"{_scaled(k, t)} AS {t}" for k, t in enumerate(PATTERN_TOPICS))
    + " FROM m",
)
def _(spark, d):
    from cohortloom.operators.aggregates import group_means

    means = group_means(fr.topic_weights(spark, d, PATTERN_TOPICS), "DX", PATTERN_TOPICS)
    return rounded(tp.scale_class_means(means, {"D1": MANUAL["AD"]}, 9))


@query(
    "sc29_group_reconstruction",
    f"WITH {PATTERNS}, {PATTERN_WEIGHTS}, m AS (" + " UNION ALL ".join(
        f"SELECT DX, {k} AS topic, avg(Topic_{k}) AS mean FROM weights GROUP BY DX" for k in range(9))
    + f") SELECT m.DX, p.pos, p.feature, {r('sum(m.mean * p.weight)')} AS value FROM m JOIN patterns p ON m.topic = p.topic "
    "GROUP BY m.DX, p.pos, p.feature",
)
def _(spark, d):
    return rounded(tp.reconstruct_groups(fr.topic_weights(spark, d, PATTERN_TOPICS), "DX", patterns(spark, d), 9))


def pattern_matrix(spark, d):
    """The nine patterns on the driver: topics x features numbers."""
    rows = bounded_rows(patterns(spark, d), 9 * len(FEATURES), "patterns")
    matrix = [[0.0] * len(FEATURES) for _ in range(9)]
    for row in rows:
        matrix[row["topic"]][row["pos"]] = row["weight"]
    return matrix


def _subjects(spark, d):
    """All features next to the topic weights of the same row."""
    c = cohort(spark, d).drop("DX")
    return c.select(*[F.col(f"`{n}`") for n in c.columns], *fr.weight_columns(PATTERN_TOPICS))


CHOSEN = [0, 2, 5, 8]
PARTIAL = (
    PATTERNS + ", " + PATTERN_WEIGHTS + ", part AS (SELECT c.id, c.pos, c.x, c.mean, c.std, "
    + " + ".join(f"w.Topic_{k} * max(p.weight) FILTER (WHERE p.topic = {k})" for k in CHOSEN)
    + " AS rec FROM signed c JOIN weights w ON c.id = w.id JOIN patterns p ON c.pos = p.pos "
    "GROUP BY c.id, c.pos, c.x, c.mean, c.std, " + ", ".join(f"w.Topic_{k}" for k in CHOSEN) + ")"
)


def _wide(value, names, digits=6):
    return ", ".join(f"{r(f'max({value}) FILTER (WHERE pos = {i})', digits)} AS {q(n)}" for i, n in enumerate(names))


@query("sc30_partial_reconstruction", f"WITH {PARTIAL} SELECT id, {_wide('7 - rec', FEATURES)} FROM part GROUP BY id")
def _(spark, d):
    built = tp.partial_reconstruction(
        _subjects(spark, d), pattern_matrix(spark, d), FEATURES, PATTERN_TOPICS, CHOSEN, ceiling=7
    )
    return rounded(built.drop(*PATTERN_TOPICS))


NMF_NAMES = swap_family(FEATURES, "VA/", "VA_nmf/")


@query(
    "sc31_mean_normalised_reweight",
    f"WITH {PARTIAL}, mean_rec AS (SELECT *, avg(rec) OVER (PARTITION BY id) + 1e-8 AS m FROM part) "
    f"SELECT id, {_wide('x * (rec / m)', NMF_NAMES)} FROM mean_rec GROUP BY id",
)
def _(spark, d):
    built = tp.reweighted_features(
        _subjects(spark, d), pattern_matrix(spark, d), FEATURES, PATTERN_TOPICS, CHOSEN, NMF_NAMES
    )
    return rounded(built.select("id", *[named(n) for n in NMF_NAMES]))


@query("sc32_topic_mask", f"WITH {PARTIAL} SELECT id, {_wide('x * rec', NMF_NAMES)} FROM part GROUP BY id")
def _(spark, d):
    built = tp.topic_masked_features(
        _subjects(spark, d), pattern_matrix(spark, d), FEATURES, PATTERN_TOPICS, CHOSEN, NMF_NAMES
    )
    return rounded(built.select("id", *[named(n) for n in NMF_NAMES]))


LOSS = swap_family(FEATURES, "VA/", "VA_adloss/")
EXPECTED = swap_family(FEATURES, "VA/", "VA_ADpred/")


@query(
    "sc33_raw_loss_and_expected",
    f"WITH {PARTIAL} SELECT id, {_wide('rec * std', LOSS)}, {_wide('mean - rec * std', EXPECTED)} FROM part GROUP BY id",
)
def _(spark, d):
    base = Baseline.fit(cohort(spark, d).filter("DX = 'D0'"), FEATURES)
    built = tp.loss_and_expected(
        _subjects(spark, d), pattern_matrix(spark, d), FEATURES, PATTERN_TOPICS, CHOSEN, base.means, base.stds, LOSS, EXPECTED
    )
    return rounded(built.select("id", *[named(n) for n in [*LOSS, *EXPECTED]]))


@query(
    "sc34_mixture_score",
    f"WITH RECURSIVE {mixture_sql('SELECT 0 AS key, ln(1 + value) AS v FROM events')} "
    f"SELECT event_id, {r('ln(1 + value)', 4)} AS v, {r('(ln(1 + value) - m1) / s1', 4)} AS v_z FROM events CROSS JOIN mixture",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.log1p("value").alias("v"))
    return rounded(mixture_score(e, "v", "v_z"), 4)


P_TRUE = "CASE DX_true WHEN 'A' THEN \"P(A)\" WHEN 'B' THEN \"P(B)\" ELSE \"P(C)\" END"


@query("sc36_probability_of_true_class", f"WITH {PREDICTIONS} SELECT o_orderkey, {r(P_TRUE)} AS p_true FROM predictions")
def _(spark, d):
    p = fr.predictions(spark, d)
    return rounded(p.select("o_orderkey", rw.probability_of(F.col("DX_true"), ["A", "B", "C"]).alias("p_true")))
