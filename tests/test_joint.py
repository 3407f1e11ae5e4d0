"""Boosted trees in common passes, and resident blocks."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from cohortloom import TopicClassifier, TopicModel
from cohortloom.models import joint, kernels, lda
from cohortloom.models.boosted import cross_validate_jointly
from cohortloom.models.common import matrix_input
from cohortloom.models.kernels import batch_matrix
from cohortloom.models.lda import fit_topics
from cohortloom.models.resident import Resident
from cohortloom.plans.analysis import best_topic_count, sweep_topics

NAMES = ["f 0", "f/1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.gamma(1.0, 1.0, (160, 3))
    label = np.array(["a", "b", "c"])[np.digitize(x[:, 0] + 0.3 * x[:, 1], [0.8, 1.8])]
    data = [(i, str(label[i]), *map(float, x[i])) for i in range(160)]
    schema = "id int, DX string, " + ", ".join(f"`{n}` double" for n in NAMES)
    return spark.createDataFrame(data, schema).repartition(3).cache(), x, label


def grow_plainly(binned, code, weight, classes, s):
    """The same boosting by loops over nodes; returns the margins and the loss before each round."""
    margin, losses = np.zeros((len(code), classes)), []
    for _ in range(s.rounds):
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-(np.log(p[np.arange(len(code)), code]) * weight).sum())
        gained = np.zeros_like(margin)
        for c in range(classes):
            g, h = (p[:, c] - (code == c)) * weight, np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16) * weight

            def grow(mine, depth):
                gain, place = joint.LEAST_GAIN, None
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.ridge)
                for k in range(binned.shape[1]):
                    for b in range(s.bins - 1):
                        left, right = mine & (binned[:, k] <= b), mine & (binned[:, k] > b)
                        if h[left].sum() >= s.child_weight and h[right].sum() >= s.child_weight:
                            new = score(left) + score(right) - score(mine)
                            if new > gain * (1 + joint.SAME):
                                gain, place = new, (left, right)
                if depth == s.depth or place is None:
                    gained[mine, c] = -s.step * g[mine].sum() / (h[mine].sum() + s.ridge)
                else:
                    for part in place:
                        grow(part, depth + 1)

            grow(np.ones(len(code), dtype=bool), 0)
        margin += gained
    return margin, losses


@pytest.mark.parametrize("balanced", [False, True])
def test_trees_equal_plain_boosting_and_loss_falls(rows, balanced):
    df, x, label = rows
    model = TopicClassifier(rounds=6, depth=3, bins=8, class_weight="balanced" if balanced else None).fit(df, NAMES, "DX")
    trees, code = model.models[0], np.searchsorted(model.classes, label)
    counts = np.bincount(code)
    weight = (len(code) / (3 * counts))[code] if balanced else np.ones(len(code))
    margin, losses = grow_plainly(joint.to_bins(x, trees.cuts), code, weight, 3, model._joint())
    assert trees.losses == pytest.approx(losses) and all(np.diff(trees.losses) < 0)
    assert trees.probabilities(x) == pytest.approx(joint.softmax(margin.T).T, abs=1e-9)
    got = model.predict(df).orderBy("id").toPandas()
    assert got[[f"P({c})" for c in model.classes]].to_numpy() == pytest.approx(trees.probabilities(x))


def test_common_passes_equal_fits_fold_by_fold(rows):
    df, _, _ = rows
    model = TopicClassifier(n_splits=3, rounds=4, depth=3, bins=16, class_weight="balanced")
    cv = model.fit_and_cross_validate(df, NAMES, "DX", ["id"]).toPandas().set_index("id").sort_index()
    assert sorted(cv.index) == list(range(160))
    names = [f"P({c})" for c in model.classes]
    spark = df.sparkSession
    fold = spark.createDataFrame([(int(i), int(f)) for i, f in cv["fold"].items()], "id int, fold int")
    coded = df.join(fold, "id").withColumn("code", F.array_position(F.lit(model.classes), F.col("DX")) - 1)
    for f in range(3):
        alone = joint.fit_jointly(coded, NAMES, "code", 3, [(0, 3, f)], model._joint(), "fold")[0]
        x = df.filter("true").orderBy("id").select(*[F.col(f"`{n}`") for n in NAMES]).toPandas().to_numpy()[cv["fold"] == f]
        assert cv.loc[cv["fold"] == f, names].to_numpy() == pytest.approx(alone.probabilities(x), abs=1e-9)
    # the model fitted in the same passes is that of a fit on all rows
    alone = TopicClassifier(rounds=4, depth=3, bins=16, class_weight="balanced").fit(df, NAMES, "DX").models[0]
    assert model.models[0].value == pytest.approx(alone.value)
    # and so are several blocks of features
    two = [TopicClassifier(n_splits=3, rounds=4, depth=3, bins=16, class_weight="balanced") for _ in range(2)]
    first, second = cross_validate_jointly(two, df, [NAMES, NAMES[:2]], "DX", ["id"])
    assert first.toPandas().set_index("id").sort_index()[names].to_numpy() == pytest.approx(cv[names].to_numpy())
    assert second.count() == 160 and two[1].features == NAMES[:2]


def test_missing_values_and_constant_columns(spark):
    data = [(i, "ab"[i % 2], None if i % 7 == 0 else float(i % 2), 1.0) for i in range(60)]
    df = spark.createDataFrame(data, "id int, DX string, x double, same double")
    model = TopicClassifier(rounds=3, depth=2).fit(df, ["x", "same"], "DX")
    got = model.predict(df).toPandas()
    assert (got["DX"] == got["DX_pred"])[got["x"].notna()].all()
    assert {r.feature: r.importance for r in model.feature_importance(spark).collect()} == {"x": 1.0, "same": 0.0}


def test_state_is_recomputed_when_lost(rows):
    df, x, _ = rows
    state = Resident(matrix_input(df, NAMES), lambda batch: {"x": batch_matrix(batch, "x"), "n": 0}, every=3)
    for k in range(8):
        state.advance(lambda block: {"x": block["x"] * 2, "n": block["n"] + 1})
        assert state.total(lambda block: block["x"].sum(axis=0), 3) == pytest.approx(x.sum(axis=0) * 2 ** (k + 1))
        if k in (1, 4):
            state.blocks.unpersist(blocking=True)  # as if its executors were gone
    assert state.blocks.getCheckpointFile() is None and state.passes == 8
    state.drop()


def test_many_topic_counts_in_common_passes(rows):
    df, _, _ = rows
    models = fit_topics(df, NAMES, [TopicModel(k, 1.0 / k, 1.0 / k, max_iter=m) for k, m in ((2, 12), (3, 7))])
    for model in models:
        alone = TopicModel(model.n_topics, model.alpha, model.beta, max_iter=model.max_iter).fit(df, NAMES)
        assert model.n_iter_ == model.max_iter and model.components == pytest.approx(alone.components)
        assert model.perplexity_ == pytest.approx(alone.perplexity_)
    quick = TopicClassifier(n_splits=2, rounds=2, depth=2)
    swept = {r.k: r for r in sweep_topics(df, NAMES, "DX", ["id"], [2, 3], 7, quick).collect()}
    assert swept[3].perplexity == pytest.approx(models[1].perplexity_) and 0 < swept[2].cv_accuracy <= 1
    assert best_topic_count(sweep_topics(df, NAMES, "DX", ["id"], [2, 3], 3, quick)).first()["k"] in (2, 3)


def test_warm_posteriors_reach_the_same_optimum_when_settled(rows):
    df, _, _ = rows
    fits = [TopicModel(2, 5.0, 1.0, max_iter=40, posterior_tol=1e-10, posterior_steps=3000, warm=w).fit(df, NAMES) for w in (False, True)]
    assert np.abs(fits[0].normalised() - fits[1].normalised()).max() < 1e-6


def test_sums_meet_in_tasks_and_the_driver_gets_splits(rows, monkeypatch):
    df, _, _ = rows
    model = TopicClassifier(n_splits=3, rounds=3, depth=5)
    want = model.fit_and_cross_validate(df, NAMES, "DX", ["id"]).toPandas().set_index("id").sort_index()
    taken, collect = [], RDD.collect

    def seen(self):
        found = collect(self)
        taken.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(joint, "MODEL_ROWS", 40)
    monkeypatch.setattr(RDD, "collect", seen)
    got = model.fit_and_cross_validate(df, NAMES, "DX", ["id"]).toPandas().set_index("id").sort_index()
    names = [f"P({c})" for c in model.classes]
    assert got[names].to_numpy() == pytest.approx(want[names].to_numpy(), abs=1e-9)
    # four models and three classes with 16 nodes at most; sums would have 3 features x 64 bins x 2 numbers a node
    assert len(taken) > 10 and max(taken) < 4 * 3 * (16 * 7 * 8 + 400)


def test_pieces_of_many_partitions_stand_in_order(spark):
    df = spark.range(40).selectExpr("array(CAST(id AS DOUBLE)) AS x").repartition(5).cache()
    state = Resident(df, lambda batch: batch_matrix(batch, "x")[:, 0])
    whole = np.concatenate(state.blocks.collect())
    state.deal(lambda b: (((int(o), int(o)), (int(o), b[b % 3 == o])) for o in range(3)), 3, lambda found: found)
    for alone in (True, False):
        sums = state.reduced(lambda b: np.array([[b[1].sum()], [len(b[1])]]), lambda b: b[0], lambda row: row * 2, 2, 3, alone)
        assert {k: float(v[0]) for k, v in sums.items()} == {
            (o, k): 2.0 * ((whole[whole % 3 == o]).sum() if k == 0 else (whole % 3 == o).sum()) for o in range(3) for k in range(2)}
    state.drop()
    df.unpersist()


def test_topic_blocks_are_not_rewritten(rows, monkeypatch):
    df, _, _ = rows
    monkeypatch.setattr(Resident, "advance", lambda self, step: pytest.fail("the blocks of a cold fit don't change"))
    assert TopicModel(2, 0.5, 0.5, max_iter=3).fit(df, NAMES).n_iter_ == 3


def test_models_of_few_rows_make_their_passes_without_jobs(rows, monkeypatch):
    df, _, _ = rows
    made = lambda: [TopicModel(k, 1.0 / k, 1.0 / k, max_iter=m, tol=t) for k, m, t in ((2, 9, 0.0), (3, 40, 1e-2), (4, 5, 0.0))]
    sums, total = [], Resident.total
    monkeypatch.setattr(Resident, "total", lambda self, of, length: sums.append(length) or total(self, of, length))
    few = fit_topics(df, NAMES, made())
    # the perplexities only; a job for each pass would be many
    assert sums == [6]
    monkeypatch.setattr(lda, "ALONE_BYTES", 0)
    for one, other in zip(few, fit_topics(df, NAMES, made())):
        assert (one.n_iter_, one.converged_) == (other.n_iter_, other.converged_) and one.mass_ == pytest.approx(other.mass_)
        assert one.components == pytest.approx(other.components) and one.perplexity_ == pytest.approx(other.perplexity_)
    assert few[1].converged_ and len(sums) > 6


def test_trees_of_few_rows_grow_in_one_task_and_are_the_same(rows, monkeypatch):
    df, _, _ = rows
    grown = lambda: TopicClassifier(n_splits=3, rounds=5, depth=4, bins=32, class_weight="balanced")
    by_levels, in_tasks = grown(), grown()
    with monkeypatch.context() as m:
        m.setattr(joint, "MODEL_BYTES", 0)
        want = by_levels.fit_and_cross_validate(df, NAMES, "DX", ["id"]).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(joint, "BLOCK_ROWS", 50)
    monkeypatch.setattr(Resident, "reduced", lambda *a: pytest.fail("a job for each level"))
    got = in_tasks.fit_and_cross_validate(df, NAMES, "DX", ["id"]).toPandas().set_index("id").sort_index()
    assert got.equals(want) or got.drop(columns=["DX_true", "DX_pred"]).to_numpy() == pytest.approx(want.drop(columns=["DX_true", "DX_pred"]).to_numpy())
    for name, value in vars(by_levels.models[0]).items():
        if name != "cuts":
            assert np.asarray(vars(in_tasks.models[0])[name]) == pytest.approx(np.asarray(value)), name
    # and quantiles are those of Spark, missing values left out
    cuts = joint.quantile_cuts(df, NAMES, 16)
    plain = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(NAMES)])
    found = plain.approxQuantile(plain.columns, [i / 16 for i in range(1, 16)], 0.1 / 16)
    assert all(np.array_equal(c, np.unique(f)) for c, f in zip(cuts, found))


def test_weights_equal_the_digamma_of_the_definition():
    x = np.geomspace(1e-2, 1e4, 500).reshape(2, 250)
    made = kernels.exp_digamma(x, *[np.empty_like(x) for _ in range(4)])
    assert np.log(made) == pytest.approx(kernels.digamma(x), rel=1e-9, abs=1e-9)
