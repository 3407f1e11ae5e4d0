"""Model fits, inference, evaluation and stored models.

Iterative fits have no SQL; their invariants are asserted in the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import frames as fr
from catalog.frames import FEATURES, PATTERN_TOPICS, PATTERN_WEIGHTS, PATTERNS, PREDICTIONS, SCORES, TOPICS, cohort, table
from catalog.registry import query, r, rounded
from catalog.relational import HASHED, patterns
from cohortloom.functions.rowwise import collapse_labels
from cohortloom.models.boosted import TopicClassifier
from cohortloom.models.lda import TopicModel
from cohortloom.models.logistic import LogisticTopicClassifier
from cohortloom.models.mixture import fit_mixtures, mixture_scores
from cohortloom.models.newton import probabilities
from cohortloom.models.nmf import FactorModel
from cohortloom.models.pca import fit_components
from cohortloom.operators import evaluate as ev
from cohortloom.operators.baseline import Baseline
from cohortloom.operators.figdata import importance_bars
from cohortloom.operators.topics import pattern_wide, subject_topic_table, topic_names
from cohortloom.plans.analysis import CohortModel, analyse_files, infer_with_logistic, sweep_topics
from cohortloom.runtime import fresh_path, settle
from cohortloom.sources.tables import read_csv, write_csv


def classed(spark, d):
    """The cohort with its ten classes collapsed to three, reference D0 kept."""
    return cohort(spark, d).withColumn("DX", collapse_labels(F.col("DX"), ["D0", "D1", "D2"], "rest"))


def patients(spark, d):
    """(scores of the non-reference rows, baseline)."""
    c = classed(spark, d)
    base = Baseline.fit(c.filter("DX = 'D0'"), FEATURES)
    return base.apply(c.filter("DX <> 'D0'")), base


_FITTED: dict[tuple, object] = {}


def shared(spark, d, name, make):
    """A fit of this session and table folder, made once for all queries that start from it.

    The key has the files' lengths and times, so changed tables are fitted anew.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/embeddings.parquet")
    held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder)
    state = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder)
    key = (spark.sparkContext.applicationId, d, name, held.getLength(), held.getFileCount(), state.getModificationTime())
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def forget():
    """Drop the shared fits, so that a timed query makes its own."""
    _FITTED.clear()


def topic_fit(spark, d):
    return shared(spark, d, "topics", lambda: TopicModel(4, 0.25, 0.25).fit(patients(spark, d)[0], FEATURES))


def factor_fit(spark, d):
    return shared(spark, d, "factors", lambda: FactorModel(4).fit(patients(spark, d)[0], FEATURES))


def tree_fit(spark, d):
    return shared(spark, d, "trees", lambda: TopicClassifier(class_weight="balanced").fit(weighted_classes(spark, d), TOPICS, "DX"))


def logistic_fit(spark, d):
    return shared(spark, d, "logistic", lambda: LogisticTopicClassifier().fit(weighted_classes(spark, d), TOPICS, "DX"))


def full_model():
    return CohortModel(n_topics=4, alpha=0.25, beta=0.25, classifier=TopicClassifier(class_weight="balanced"))


# ---- topics ----------------------------------------------------------------------------
@query("ml1_topic_fit_patterns")
def _(spark, d):
    return rounded(topic_fit(spark, d).patterns(spark))


@query(
    "ml1b_topic_mass_per_feature",
    # a pass hands out all of the data, so the topics of a feature add up to its sum and the priors
    f"WITH {SCORES} SELECT pos, feature, {r('sum(s) + 4 * 0.25', 4)} AS mass FROM scores WHERE DX <> 'D0' GROUP BY pos, feature",
)
def _(spark, d):
    made = topic_fit(spark, d).patterns(spark, normalised=False)
    return rounded(made.groupBy("pos", "feature").agg(F.sum("weight").alias("mass")), 4)


@query("ml2_topic_weights_of_new_rows")
def _(spark, d):
    model, base = topic_fit(spark, d), patients(spark, d)[1]
    new = base.apply(classed(spark, d))
    return rounded(model.transform(new).select("id", *model.topics))


@query("ml3_topic_perplexity")
def _(spark, d):
    model = topic_fit(spark, d)
    return rounded(spark.createDataFrame([(4, model.perplexity_)], "k int, perplexity double"))


@query("ml4_factor_fit_patterns")
def _(spark, d):
    return rounded(factor_fit(spark, d).patterns(spark))


@query("ml4b_factor_weights_of_new_rows")
def _(spark, d):
    model, base = factor_fit(spark, d), patients(spark, d)[1]
    new = base.apply(classed(spark, d))
    return rounded(model.transform(new, prefix="nmf/Topic_").select("id", *topic_names(4, "nmf/Topic_")))


@query(
    "ml5_two_component_mixture",
    f"WITH RECURSIVE {fr.mixture_sql('SELECT 0 AS key, ln(1 + value) AS v FROM events')} "
    f"SELECT CAST(0 AS INTEGER) AS part, {r('m1', 3)} AS mean, {r('s1', 3)} AS std, {r('w1', 3)} AS weight FROM mixture UNION ALL "
    f"SELECT 1, {r('m2', 3)}, {r('s2', 3)}, {r('w2', 3)} FROM mixture",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.log1p("value").alias("v"))
    return rounded(fit_mixtures(e, ["v"]).select("part", "mean", "std", "weight"), 3)


def _both_values(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.log1p("value").alias("v"), F.sqrt("value").alias("w"))


BOTH_VALUES = (
    "SELECT event_type || '/v' AS key, ln(1 + value) AS v FROM events UNION ALL SELECT event_type || '/w', sqrt(value) FROM events"
)


@query(
    "ml5b_mixtures_of_groups",
    f"WITH RECURSIVE {fr.mixture_sql(BOTH_VALUES)}, parts AS (SELECT key, 0 AS part, m1 AS mean, s1 AS std, w1 AS weight FROM mixture "
    "UNION ALL SELECT key, 1, m2, s2, w2 FROM mixture) SELECT split_part(key, '/', 1) AS event_type, split_part(key, '/', 2) AS score, "
    f"CAST(part AS INTEGER) AS part, {r('mean', 3)} AS mean, {r('std', 3)} AS std, {r('weight', 3)} AS weight FROM parts",
)
def _(spark, d):
    return rounded(fit_mixtures(_both_values(spark, d), ["v", "w"], ["event_type"]), 3)


@query(
    "ml5c_scores_of_groups",
    f"WITH RECURSIVE {fr.mixture_sql(BOTH_VALUES)} SELECT event_id, {r('(ln(1 + value) - a.m1) / a.s1', 3)} AS v_z, "
    f"{r('(sqrt(value) - b.m1) / b.s1', 3)} AS w_z FROM events LEFT JOIN mixture a ON a.key = event_type || '/v' "
    "LEFT JOIN mixture b ON b.key = event_type || '/w'",
)
def _(spark, d):
    scored = mixture_scores(_both_values(spark, d), {"v": "v_z", "w": "w_z"}, ["event_type"])
    return rounded(scored.select("event_id", "v_z", "w_z"), 3)


@query("ml6_component_scores")
def _(spark, d):
    c = cohort(spark, d)
    model = fit_components(c, FEATURES, 8)
    return rounded(model.scores(c).select("id", *model.names), 4)


@query("ml6b_component_loadings")
def _(spark, d):
    return rounded(fit_components(cohort(spark, d), FEATURES, 8).loading_table(spark), 4)


# ---- classifiers ---------------------------------------------------------------------------
def weighted_classes(spark, d):
    w = fr.topic_weights(spark, d)
    return w.withColumn("DX", collapse_labels(F.col("DX"), ["D1", "D2"], "rest"))


@query("ml7_boosted_classes")
def _(spark, d):
    w, model = weighted_classes(spark, d), tree_fit(spark, d)
    return rounded(model.predict(w).select("id", *[f"`P({c})`" for c in model.classes], "DX_pred"))


@query(
    "ml8_balanced_weights",
    "SELECT o_orderkey, o_orderpriority, "
    + r("count(*) OVER () / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*) OVER (PARTITION BY o_orderpriority))")
    + " AS weight FROM orders",
)
def _(spark, d):
    return rounded(ev.balanced_weights(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))


@query(
    "ml9_label_codes",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_code, c_mktsegment AS back FROM customer",
)
def _(spark, d):
    coded, classes = ev.encode_labels(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return ev.decode_labels(coded, "label_code", classes, "back").select("c_custkey", "label_code", "back")


@query("ml10_predict_with_probabilities")
def _(spark, d):
    w, model = weighted_classes(spark, d), tree_fit(spark, d)
    return rounded(model.predict(w.select("id", *TOPICS)).drop(*TOPICS))


def tree_folds(spark, d):
    model = TopicClassifier(class_weight="balanced")
    return shared(spark, d, "tree folds", lambda: settle(model.cross_validate(weighted_classes(spark, d), TOPICS, "DX", ["id"])))


def logistic_folds(spark, d):
    model = LogisticTopicClassifier()
    return shared(spark, d, "logistic folds", lambda: settle(model.cross_validate(weighted_classes(spark, d), TOPICS, "DX", ["id"])))


@query("ml11_out_of_fold_predictions")
def _(spark, d):
    return rounded(tree_folds(spark, d))


FOLDS = (
    "WITH c AS (SELECT vec_id AS id, CASE WHEN label IN (1, 2) THEN 'D' || CAST(label AS VARCHAR) ELSE 'rest' END AS DX_true "
    "FROM embeddings) SELECT id, DX_true, CAST((row_number() OVER (PARTITION BY DX_true ORDER BY "
    f"{HASHED.format(id='id')}) - 1) % 5 AS INTEGER) AS fold FROM c"
)


@query("ml11b_rows_of_out_of_fold_predictions", FOLDS)
def _(spark, d):
    return tree_folds(spark, d).select("id", "DX_true", "fold")


@query("ml12c_rows_of_logistic_out_of_fold", FOLDS)
def _(spark, d):
    return logistic_folds(spark, d).select("id", "DX_true", "fold")


@query("ml12_multinomial_logistic")
def _(spark, d):
    return rounded(logistic_fit(spark, d).coefficients(spark), 3)


@query("ml12b_logistic_out_of_fold")
def _(spark, d):
    return rounded(logistic_folds(spark, d), 3)


@query(
    "ml12d_logistic_mass_of_folds",
    # intercepts are free, so the probabilities that a fold's model gives its own rows add up to the class counts
    f"WITH folded AS ({FOLDS}) SELECT CAST(m.left_out AS INTEGER) AS left_out, f.DX_true AS DX, "
    + r("count(*)", 3)
    + " AS mass FROM folded f JOIN range(5) m(left_out) ON f.fold <> m.left_out GROUP BY 1, 2",
)
def _(spark, d):
    model = LogisticTopicClassifier()
    folded = model.cross_validate(weighted_classes(spark, d), TOPICS, "DX", ["id"]).select("id", "fold")
    rows = weighted_classes(spark, d).select("id", *TOPICS).join(folded, "id")
    found = spark.createDataFrame([(k, m.raw()) for k, m in enumerate(model.fold_models)], "left_out int, raw array<double>")
    # five models, one row each
    seen = rows.join(F.broadcast(found), F.col("fold") != F.col("left_out"))
    classes = ["D1", "D2", "rest"]
    scored = seen.select("left_out", F.posexplode(probabilities(TOPICS, len(classes), F.col("raw"))).alias("pos", "p"))
    mass = scored.groupBy("left_out", "pos").agg(F.sum("p").alias("mass"))
    return rounded(mass.select("left_out", F.get(F.lit(classes), F.col("pos")).alias("DX"), "mass"), 3)


@query("fd8b_importance_bars")
def _(spark, d):
    return rounded(importance_bars(tree_fit(spark, d).feature_importance(spark)))


@query("ml13_feature_importance")
def _(spark, d):
    return rounded(tree_fit(spark, d).feature_importance(spark))


# ---- evaluation ----------------------------------------------------------------------------
LABELS = ["A", "B", "C", "none"]
GRID = (
    "lab AS (SELECT unnest(['A','B','C','none']) AS l), grid AS (SELECT a.l AS observed, b.l AS predicted "
    "FROM lab a CROSS JOIN lab b), cells AS (SELECT DX_true AS observed, DX_pred AS predicted, count(*) AS n "
    "FROM predictions GROUP BY 1, 2)"
)


@query(
    "ml14_confusion_matrix",
    f"WITH {PREDICTIONS}, {GRID} SELECT g.observed, g.predicted, coalesce(c.n, 0) AS n, "
    + r("coalesce(c.n / (SELECT sum(n) FROM cells t WHERE t.observed = g.observed), 0)")
    + " AS share FROM grid g LEFT JOIN cells c ON g.observed = c.observed AND g.predicted = c.predicted",
)
def _(spark, d):
    return rounded(ev.confusion_counts(fr.predictions(spark, d), "DX_true", "DX_pred", LABELS))


@query(
    "ml15_accuracy",
    f"WITH {fr.PAIRS} SELECT {r('avg(CASE WHEN observed = predicted THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n "
    "FROM pairs WHERE observed IS NOT NULL AND predicted IS NOT NULL",
)
def _(spark, d):
    return rounded(ev.accuracy(fr.pairs(spark, d), "observed", "predicted"))


@query(
    "ml16_classification_report",
    f"WITH {PREDICTIONS}, {GRID}, s AS (SELECT l AS label, "
    "coalesce((SELECT sum(n) FROM cells WHERE observed = l), 0) AS support, "
    "coalesce((SELECT sum(n) FROM cells WHERE predicted = l), 0) AS p, "
    "coalesce((SELECT sum(n) FROM cells WHERE observed = l AND predicted = l), 0) AS h FROM lab), "
    "m AS (SELECT label, support, h, coalesce(h / nullif(p, 0), 0.0) AS precision, coalesce(h / nullif(support, 0), 0.0) AS recall, "
    "coalesce(2.0 * h / nullif(p + support, 0), 0.0) AS f1 FROM s), t AS ("
    "SELECT label, precision, recall, f1, support FROM m UNION ALL "
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m UNION ALL "
    "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), sum(support) FROM m UNION ALL "
    "SELECT 'accuracy', sum(h) / sum(support), sum(h) / sum(support), sum(h) / sum(support), sum(support) FROM m) "
    f"SELECT label, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM t",
)
def _(spark, d):
    return rounded(ev.classification_report(fr.predictions(spark, d), "DX_true", "DX_pred", LABELS))


# ---- whole analyses ------------------------------------------------------------------------
@query("ml17_topic_count_sweep")
def _(spark, d):
    scored, _ = patients(spark, d)
    swept = lambda: sweep_topics(scored, FEATURES, "DX", ["id"], range(4, 26, 2), classifier=TopicClassifier(class_weight="balanced"), tol=1e-5)
    return rounded(shared(spark, d, "sweep", swept))


def _fitted(spark, d):
    def make():
        c, model = classed(spark, d), full_model()
        train, reference = c.filter("DX <> 'D0'"), c.filter("DX = 'D0'")
        return model, model.fit(train, FEATURES, True, reference, "DX", "id")

    return shared(spark, d, "cohort", make)


@query("ml18_infer_new_cohort")
def _(spark, d):
    model, _ = _fitted(spark, d)
    return rounded(model.infer(classed(spark, d), subject="id", reference_label="D0"))


@query("ml19_infer_with_logistic")
def _(spark, d):
    scored, base = patients(spark, d)
    topics = topic_fit(spark, d)
    weights = topics.transform(scored).select("id", "DX", *topics.topics)
    classifier = LogisticTopicClassifier().fit(weights, topics.topics, "DX")
    return rounded(infer_with_logistic(classed(spark, d), topics, classifier, base, "id", "DX"), 3)


@query("ml20_fit_end_to_end")
def _(spark, d):
    return rounded(_fitted(spark, d)[1]["cv"])


@query("ml20b_out_of_fold_report")
def _(spark, d):
    return rounded(_fitted(spark, d)[1]["cv_report"])


@query("ml20c_out_of_fold_confusion")
def _(spark, d):
    return rounded(_fitted(spark, d)[1]["cv_confusion"])


@query("ml21_analyse_files")
def _(spark, d):
    folder = fresh_path(spark, "analysis")
    c = classed(spark, d).withColumnsRenamed({f: f.replace("/", "_") for f in FEATURES}).withColumnRenamed("id", "PTID")
    path = write_csv(c, f"{folder}/input")
    schema = "PTID long, DX string, " + ", ".join(f"{f.replace('/', '_')} double" for f in FEATURES)
    _, fitted = analyse_files(
        spark, path, path, "VA_0", "VA_63", folder, "D0", model=full_model(), save_model=False, schema=schema
    )
    return rounded(fitted["weights"])


@query(
    "ml22_subject_and_pattern_tables",
    f"WITH {PATTERNS}, {PATTERN_WEIGHTS} SELECT 'subject' AS part, CAST(id AS VARCHAR) AS key, DX, "
    + ", ".join(f"{r(t)} AS {t}" for t in PATTERN_TOPICS)
    + " FROM weights UNION ALL SELECT 'pattern', feature, NULL, "
    + ", ".join(r(f"max(weight) FILTER (WHERE topic = {k})") for k in range(9))
    + " FROM patterns GROUP BY feature",
)
def _(spark, d):
    subjects = subject_topic_table(fr.topic_weights(spark, d, PATTERN_TOPICS), ["id"], "DX", 9).select(
        F.lit("subject").alias("part"), F.col("id").cast("string").alias("key"), "DX", *PATTERN_TOPICS
    )
    features = pattern_wide(patterns(spark, d), 9).select(
        F.lit("pattern").alias("part"), F.col("feature").alias("key"), F.lit(None).cast("string").alias("DX"), *PATTERN_TOPICS
    )
    return rounded(subjects.unionByName(features))


# ---- stored results and models ---------------------------------------------------------------
@query("io8_result_bundle")
def _(spark, d):
    model, fitted = _fitted(spark, d)
    paths = model.save_results(fitted, fresh_path(spark, "bundle"))
    return rounded(read_csv(spark, paths["subject_weights"]))


@query("io10_topic_model_store")
def _(spark, d):
    scored, _ = patients(spark, d)
    model = topic_fit(spark, d)
    path = fresh_path(spark, "topics")
    model.save(spark, path)
    return rounded(TopicModel.load(spark, path).transform(scored).select("id", *model.topics))


def agreeing(first, second, names):
    """(id, agrees): whether two results have equal numbers and labels for a row."""
    other = second.select("id", *[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
    same = [F.col(f"`{n}`").eqNullSafe(F.col(f"_{i}")) for i, n in enumerate(names)]
    return first.join(other, "id", "full").select("id", reduce(lambda a, b: a & b, same).alias("agrees"))


@query("io10c_stored_topics_agree", "SELECT vec_id AS id, true AS agrees FROM embeddings WHERE label <> 0")
def _(spark, d):
    scored, _ = patients(spark, d)
    model, path = topic_fit(spark, d), fresh_path(spark, "topics")
    model.save(spark, path)
    return agreeing(model.transform(scored), TopicModel.load(spark, path).transform(scored), model.topics)


@query("io10d_stored_factors_agree", "SELECT vec_id AS id, true AS agrees FROM embeddings WHERE label <> 0")
def _(spark, d):
    scored, _ = patients(spark, d)
    model, path = factor_fit(spark, d), fresh_path(spark, "factors")
    model.save(spark, path)
    return agreeing(model.transform(scored), FactorModel.load(spark, path).transform(scored), model.topics)


@query("io11b_stored_classifier_agrees", "SELECT vec_id AS id, true AS agrees FROM embeddings")
def _(spark, d):
    w, model, path = weighted_classes(spark, d), tree_fit(spark, d), fresh_path(spark, "classifier")
    model.save(spark, path)
    names = [*[f"P({c})" for c in model.classes], "DX_pred"]
    return agreeing(model.predict(w), TopicClassifier.load(spark, path).predict(w), names)


@query("io11_classifier_store")
def _(spark, d):
    w = weighted_classes(spark, d)
    path = fresh_path(spark, "classifier")
    tree_fit(spark, d).save(spark, path)
    return rounded(TopicClassifier.load(spark, path).predict(w).drop(*TOPICS))


@query("io10b_factor_model_store")
def _(spark, d):
    scored, _ = patients(spark, d)
    path = fresh_path(spark, "factors")
    factor_fit(spark, d).save(spark, path)
    model = FactorModel.load(spark, path)
    return rounded(model.transform(scored).select("id", *model.topics))


@query("io12_analysis_store")
def _(spark, d):
    model, _ = _fitted(spark, d)
    path = fresh_path(spark, "model")
    model.save(spark, path)
    return rounded(CohortModel.load(spark, path).infer(classed(spark, d), subject="id", standardize=True))


