"""Invariants and planted-structure recovery of the iterative fits."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom import CohortModel, FactorModel, LogisticTopicClassifier, TopicClassifier, TopicModel
from cohortloom.models import kernels
from cohortloom.models.mixture import fit_mixtures, mixture_score, mixture_scores, two_components
from cohortloom.models.pca import fit_components
from cohortloom.plans.analysis import analyse_files, best_topic_count, infer_with_logistic, sweep_topics
from cohortloom.operators.baseline import Baseline
from cohortloom.runtime import fresh_path
from cohortloom.sources.tables import read_csv, write_csv

WIDTH, TOPICS = 12, 3
NAMES = [f"VA/{i}" for i in range(WIDTH)]


@pytest.fixture(scope="module")
def planted(spark):
    """Three blocks of four features; each row mostly uses one block."""
    rng = np.random.default_rng(7)
    blocks = np.kron(np.eye(TOPICS), np.ones(WIDTH // TOPICS))
    main = rng.integers(0, TOPICS, 150)
    weights = rng.uniform(0, 0.15, (150, TOPICS))
    weights[np.arange(150), main] += rng.uniform(1, 2, 150)
    x = weights @ blocks + rng.uniform(0, 0.05, (150, WIDTH))
    data = [(i, f"C{main[i]}", *map(float, x[i])) for i in range(150)]
    schema = "PTID int, DX string, " + ", ".join(f"`{n}` double" for n in NAMES)
    return spark.createDataFrame(data, schema).repartition(3).cache(), x


def block_of(pattern):
    return int(pattern.reshape(TOPICS, -1).sum(axis=1).argmax())


def test_kernels_match_known_values():
    assert kernels.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-9)
    assert kernels.log_gamma(np.array([0.5, 5.0, 30.0])) == pytest.approx([0.5723649429, 3.1780538303, 71.2570389672], abs=1e-8)
    h = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    w = np.array([[2.0, 0.0], [0.5, 3.0]])
    assert kernels.nonnegative_weights(w @ h, h) == pytest.approx(w, abs=1e-6)


def test_topic_fit_invariants_and_recovery(spark, planted):
    df, x = planted
    alpha = 1.0 / TOPICS
    model = TopicModel(TOPICS, alpha, alpha, max_iter=40, tol=0.0).fit(df, NAMES)
    # every step hands out the whole input mass plus the prior
    assert model.mass_ == pytest.approx([x.sum() + alpha * TOPICS * WIDTH] * len(model.mass_), rel=1e-9)
    assert sorted(block_of(p) for p in model.normalised()) == [0, 1, 2]
    weights = model.transform(df).select("PTID", *model.topics).toPandas().set_index("PTID").sort_index()
    assert np.abs(weights.sum(axis=1) - 1).max() < 1e-9
    assert 1.0 < model.perplexity_ < WIDTH
    assert model.perplexity(df) == pytest.approx(model.perplexity_)


def test_topic_guards(planted):
    with pytest.raises(RuntimeError):
        TopicModel().transform(planted[0])
    with pytest.raises(RuntimeError):
        FactorModel().transform(planted[0])
    with pytest.raises(RuntimeError):
        TopicClassifier().predict(planted[0])
    with pytest.raises(RuntimeError):
        CohortModel().infer(planted[0])
    with pytest.raises(ValueError):
        CohortModel().fit(planted[0], NAMES, standardize=True)


def test_factor_error_never_rises(planted):
    df, x = planted
    model = FactorModel(TOPICS, max_iter=30, tol=0.0).fit(df, NAMES)
    errors = np.array(model.errors_)
    assert (np.diff(errors) <= 1e-6 * errors[0]).all()
    assert errors[-1] < 0.02 * (x**2).sum()
    assert sorted(block_of(p) for p in model.normalised()) == [0, 1, 2]
    w = model.transform(df).orderBy("PTID").select(*model.topics).toPandas().to_numpy()
    assert (w >= 0).all() and ((x - w @ model.components) ** 2).sum() == pytest.approx(errors[-1], rel=1e-3)


def test_components_are_centred_and_match_numpy(planted):
    df, x = planted
    model = fit_components(df, NAMES, 4)
    scores = model.scores(df).select(*model.names).toPandas().to_numpy()
    assert np.abs(scores.mean(axis=0)).max() < 1e-9
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:4]
    assert scores.var(axis=0, ddof=1) == pytest.approx(values, rel=1e-6)
    assert (model.loadings[np.abs(model.loadings).argmax(axis=0), range(4)] > 0).all()


def test_loadings_are_orthonormal_in_feature_order(spark, planted):
    df, _ = planted
    model = fit_components(df, NAMES, 3)
    got = model.loading_table(spark).toPandas().sort_values("pos")
    assert list(got["feature"]) == NAMES
    matrix = got[model.names].to_numpy()
    assert np.allclose(matrix.T @ matrix, np.eye(3), atol=1e-8)


def test_factor_model_store_gives_equal_weights(spark, planted):
    df, _ = planted
    model = FactorModel(TOPICS).fit(df, NAMES)
    path = fresh_path(spark, "factors")
    model.save(spark, path)
    again = FactorModel.load(spark, path)
    assert again.converged_ and again.features == NAMES
    one, two = (m.transform(df).select("PTID", *m.topics).toPandas().sort_values("PTID").to_numpy() for m in (model, again))
    assert np.array_equal(one, two)


def test_mixture_uses_the_lower_part(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(1, 0.1, 400), rng.normal(3, 0.3, 200)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    low, high = two_components(df, "v")
    assert low[0] == pytest.approx(1.0, abs=0.05) and high[0] == pytest.approx(3.0, abs=0.1)
    assert low[1] == pytest.approx(0.1, abs=0.03)
    # the same steps in plain numpy
    x, cut = v - v.mean(), None
    a, b = x.min(), x.max()
    for _ in range(100):
        cut = (a + b) / 2
        new = x[x <= cut].mean(), x[x > cut].mean()
        moved, (a, b) = (new[0] - a) ** 2 + (new[1] - b) ** 2, new
        if moved <= 1e-4 * x.var():
            break
    share, before = (x <= (a + b) / 2).astype(float), -np.inf
    while True:
        parts = []
        for s in (share, 1 - share):
            m = (s * x).sum() / s.sum()
            parts.append((m, (s * (x - m) ** 2).sum() / s.sum() + 1e-6, s.mean()))
        logs = np.array([np.log(w) - 0.5 * np.log(2 * np.pi * var) - (x - m) ** 2 / (2 * var) for m, var, w in parts])
        level = np.logaddexp(*logs)
        share = np.exp(logs[0] - level)
        if abs(level.mean() - before) < 1e-3:
            break
        before = level.mean()
    m = (share * x).sum() / share.sum()
    assert low[0] == pytest.approx(m + v.mean(), abs=1e-8)
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert two_components(same, "v")[0][0] == pytest.approx(2.0)
    assert "z" in mixture_score(df, "v", "z").columns
    assert mixture_score(df.filter("v is null"), "v", "z").columns == ["v"]


def test_mixtures_of_groups_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    rows = []
    # a third of the rows in one group, a null group, a group of one value and one of equal values
    for g, n, far in (("big", 400, 3.0), ("far", 150, 9.0), (None, 120, 5.0)):
        a = np.concatenate([rng.normal(1, 0.2, n), rng.normal(far, 0.3, n // 2)])
        rows += [(g, float(x), float(x * x)) for x in a]
    rows += [("one", 1.0, None), ("same", 2.0, float("nan")), ("same", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(3)
    got = {(r["g"], r["score"], r["part"]): (r["mean"], r["std"], r["weight"]) for r in fit_mixtures(df, ["v", "w"], ["g"]).collect()}
    assert {k[:2] for k in got} == {(g, s) for g in ("big", "far", None) for s in "vw"} | {("same", "v")}
    for g, score in {k[:2] for k in got}:
        alone = two_components(df.filter(F.col("g").eqNullSafe(F.lit(g))), score)
        for part in (0, 1):
            assert got[g, score, part] == pytest.approx(alone[part], rel=1e-9)
    scored = mixture_scores(df, {"v": "v_z", "w": "w_z"}, ["g"]).toPandas()
    assert len(scored) == len(rows) and list(scored.columns) == ["g", "v", "w", "v_z", "w_z"]
    far = scored[scored["g"] == "far"]
    assert far["v_z"].to_numpy() == pytest.approx((far["v"].to_numpy() - got["far", "v", 0][0]) / got["far", "v", 0][1])
    assert scored.loc[scored["g"] == "one", "v_z"].isna().all() and scored.loc[scored["g"].isna(), "v_z"].notna().all()
    none = fit_mixtures(df.limit(0), ["v"], ["g"])
    assert none.columns == ["g", "score", "part", "mean", "std", "weight"] and none.count() == 0


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_trees_beat_majority_and_reload(spark, planted, kind):
    df, _ = planted
    model = TopicClassifier(kind, n_splits=3, rounds=3 if kind == "boosted" else 10, depth=3, class_weight="balanced")
    model.fit(df, NAMES, "DX")
    got = model.predict(df).toPandas()
    assert np.abs(got[["P(C0)", "P(C1)", "P(C2)"]].sum(axis=1) - 1).max() < 1e-9
    assert (got["DX"] == got["DX_pred"]).mean() > 0.9
    path = fresh_path(spark, "trees")
    model.save(spark, path)
    again = TopicClassifier.load(spark, path).predict(df).toPandas()
    assert again.sort_values("PTID")["P(C1)"].tolist() == got.sort_values("PTID")["P(C1)"].tolist()
    importance = model.feature_importance(spark).collect()
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)


def test_out_of_fold_covers_every_row_once(planted):
    df, _ = planted
    model = TopicClassifier("forest", n_splits=3, rounds=10, depth=3)
    cv = model.cross_validate(df, NAMES, "DX", ["PTID"]).toPandas()
    assert sorted(cv["PTID"]) == list(range(150))
    assert cv.groupby("DX_true")["fold"].value_counts().groupby(level=0).agg(lambda s: s.max() - s.min()).max() <= 1
    assert (cv["DX_true"] == cv["DX_pred"]).mean() > 0.8


def slope_of(model, classes, x, y):
    """Gradient of the summed log loss plus half the squared weights, in numpy."""
    z = (x - np.array(model.center)) / np.array(model.scale)
    coef = np.array(model.coefficients)
    logits = z @ coef.T + np.array(model.intercepts)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = (y[:, None] == np.array(classes)[None, :]).astype(float)
    return np.concatenate([(p - hit).T @ z + coef, (p - hit).sum(axis=0)[:, None]], axis=1)


def test_logistic_matches_stationarity(spark, planted):
    df, x = planted
    model = LogisticTopicClassifier(n_splits=3, max_iter=200).fit(df, NAMES[:3], "DX")
    pdf = df.toPandas()
    slope = slope_of(model.model, model.classes, pdf[NAMES[:3]].to_numpy(), pdf["DX"].to_numpy())
    assert np.abs(slope).max() < 1e-6 and model.model.converged and model.model.steps < 20
    assert (np.diff(model.model.losses) <= 1e-9).all()
    shown = model.coefficients(spark).toPandas().set_index("DX").loc[model.classes].to_numpy()
    assert shown.tolist() == model.model.coefficients
    assert abs(sum(model.model.intercepts)) < 1e-9


def test_logistic_folds_share_passes_and_equal_single_fits(spark, planted):
    df, _ = planted
    joint = LogisticTopicClassifier(n_splits=3)
    cv = joint.fit_and_cross_validate(df, NAMES[:4], "DX", ["PTID"]).toPandas().set_index("PTID")
    assert len(cv) == 150 and len(joint.fold_models) == 3
    pdf = df.toPandas()
    pdf["fold"] = pdf["PTID"].map(cv["fold"])
    for k, model in enumerate(joint.fold_models):
        rest, out = pdf[pdf["fold"] != k], pdf[pdf["fold"] == k]
        assert model.center == pytest.approx(rest[NAMES[:4]].mean().tolist(), rel=1e-12)
        assert np.abs(slope_of(model, joint.classes, rest[NAMES[:4]].to_numpy(), rest["DX"].to_numpy())).max() < 1e-6
        alone = LogisticTopicClassifier().fit(spark.createDataFrame(rest), NAMES[:4], "DX")
        assert np.array(alone.model.coefficients) == pytest.approx(np.array(model.coefficients), abs=1e-6)
        own = alone.predict(spark.createDataFrame(out)).toPandas().set_index("PTID")
        for c in joint.classes:
            assert own[f"P({c})"].to_numpy() == pytest.approx(cv.loc[own.index, f"P({c})"].to_numpy(), abs=1e-6)
    whole = LogisticTopicClassifier().fit(df, NAMES[:4], "DX")
    assert np.array(whole.model.coefficients) == pytest.approx(np.array(joint.model.coefficients), abs=1e-6)


def test_logistic_defined_results_at_the_edges(spark):
    rows = [(i, "A" if i % 2 else "B", float(i % 3), 1.0) for i in range(30)] + [(99, "only", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, DX string, v double, flat double")
    joint = LogisticTopicClassifier(n_splits=3)
    cv = joint.cross_validate(df, ["v", "flat"], "DX", ["id"]).toPandas().set_index("id")
    # the class of one row is absent where that row is left out: probability zero, no failure
    assert cv.loc[99, "P(only)"] == 0.0 and np.allclose(cv[["P(A)", "P(B)", "P(only)"]].sum(axis=1), 1.0)
    model = LogisticTopicClassifier().fit(df, ["v", "flat"], "DX")
    gap = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0)], "id int, v double, flat double")
    assert [tuple(r) for r in model.predict(gap).select("P(A)", "DX_pred").collect()] == [(None, None)] * 2
    with pytest.raises(ValueError, match="missing values in v"):
        LogisticTopicClassifier().fit(df.withColumn("v", F.lit(None).cast("double")), ["v", "flat"], "DX")
    path = fresh_path(spark, "logistic")
    model.save(spark, path)
    again = LogisticTopicClassifier.load(spark, path)
    names = ["id", "P(A)", "P(B)", "P(only)"]
    assert again.predict(df).select(names).collect() == model.predict(df).select(names).collect()


def test_whole_analysis_round_trip(spark, planted):
    df, _ = planted
    quick = TopicClassifier("forest", n_splits=3, rounds=10, depth=3)
    reference = df.filter("DX = 'C0'")
    train = df.filter("DX <> 'C0'")
    model = CohortModel(TOPICS, 0.3, 0.3, max_iter=10, classifier=quick)
    fitted = model.fit(train, NAMES, True, reference, "DX", "PTID")
    assert fitted["cv"].count() == train.count()
    path = fresh_path(spark, "analysis")
    model.save(spark, path)
    again = CohortModel.load(spark, path)
    first = model.infer(train, standardize=True).toPandas().sort_values("SUBJ_ID")
    second = again.infer(train, standardize=True).toPandas().sort_values("SUBJ_ID")
    assert first.to_numpy().tolist() == second.to_numpy().tolist()
    # the fit's own weights come back for the training rows
    kept = fitted["weights"].toPandas().sort_values("PTID")
    assert np.allclose(first["Topic_0"], kept["Topic_0"], atol=1e-9)
    renamed = train.withColumnsRenamed({n: n + "_zscore" for n in NAMES})
    mapped = model.infer(renamed, feature_map={n: n + "_zscore" for n in NAMES}).toPandas().sort_values("SUBJ_ID")
    plain = model.infer(train).toPandas().sort_values("SUBJ_ID")
    assert np.allclose(mapped["Topic_1"], plain["Topic_1"])
    with pytest.raises(ValueError):
        model.infer(train.withColumn(NAMES[0], F.lit(None).cast("double")))
    paths = model.save_results(fitted, fresh_path(spark, "tables"))
    assert set(paths) == {"topic_patterns", "subject_weights", "group_means", "cv_results"}
    assert read_csv(spark, paths["topic_patterns"]).columns[0] == "feature"


def test_analysis_from_files_and_logistic_inference(spark, planted):
    df, _ = planted
    folder = fresh_path(spark, "files")
    path = write_csv(df, f"{folder}/in")
    model = CohortModel(TOPICS, 0.3, 0.3, max_iter=5, classifier=LogisticTopicClassifier(3, max_iter=30))
    model, fitted = analyse_files(spark, path, path, NAMES[0], NAMES[-1], folder, "C0", model=model)
    assert fitted["weights"].count() == df.filter("DX <> 'C0'").count()
    assert CohortModel.load(spark, f"{folder}/model").classifier.classes == ["C1", "C2"]
    base = Baseline.fit(df.filter("DX = 'C0'"), NAMES)
    got = infer_with_logistic(df, model.topics, model.classifier, base)
    assert {"SubjectID", "True_DX", "Predicted_DX", "P(C1)", "Topic_0"} <= set(got.columns) and got.count() == 150


def test_sweep_and_best(spark, planted):
    df, _ = planted
    results = sweep_topics(df, NAMES, "DX", ["PTID"], [2, 3], 5, TopicClassifier("forest", 3, rounds=5, depth=2))
    assert sorted(r["k"] for r in results.collect()) == [2, 3]
    assert best_topic_count(results).first()["k"] in (2, 3)


def test_topic_match_is_up_to_order(planted):
    # two fits with different seeds find the same blocks in some order
    df, _ = planted
    a = TopicModel(TOPICS, 0.3, 0.3, 20, seed=1).fit(df, NAMES, False).normalised()
    b = TopicModel(TOPICS, 0.3, 0.3, 20, seed=2).fit(df, NAMES, False).normalised()
    assert min(np.abs(a - b[list(p)]).max() for p in permutations(range(TOPICS))) < 0.05
