"""Tree classifier on topic weights with class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, quoted
from cohortloom.models.common import cached, map_rows, read_json, write_json
from cohortloom.models.crossval import folded_rows, out_of_fold, shown_predictions
from cohortloom.models.joint import Settings, Trees, fit_jointly
from cohortloom.operators.evaluate import accuracy, balanced_weights, classification_report, confusion_counts, encode_labels
from cohortloom.runtime import shared_folder


class TopicClassifier:
    """Boosted trees with one softmax over all classes (``models/joint.py``).

    ``kind='forest'`` fits a multiclass random forest instead. ``rounds`` is the number of boosting rounds, each with
    a tree per class, or of the forest's trees; ``ridge`` and ``child_weight`` belong to boosting; ``row_share``,
    ``rows_per_leaf`` and ``features_per_split`` to the forest.
    """

    def __init__(
        self,
        kind: str = "boosted",
        n_splits: int = 5,
        seed: int = 42,
        class_weight: str | None = None,
        rounds: int = 100,
        depth: int = 6,
        step: float = 0.3,
        workers: int = 2,
        row_share: float = 1.0,
        rows_per_leaf: int = 1,
        features_per_split: str = "auto",
        bins: int = 64,
        ridge: float = 1.0,
        child_weight: float = 1.0,
    ):
        if kind not in ("boosted", "forest"):
            raise ValueError(f"unknown kind {kind!r}")
        self.kind, self.n_splits, self.seed, self.class_weight = kind, n_splits, seed, class_weight
        self.rounds, self.depth, self.step, self.workers = rounds, depth, step, workers
        self.trees = dict(row_share=row_share, rows_per_leaf=rows_per_leaf, features_per_split=features_per_split, bins=bins,
                          ridge=ridge, child_weight=child_weight)
        self.features: list[str] | None = None
        self.classes: list[str] | None = None
        self.models: list = []

    def _engine(self) -> dict:
        t = self.trees
        return dict(subsamplingRate=t["row_share"], minInstancesPerNode=t["rows_per_leaf"],
                    featureSubsetStrategy=t["features_per_split"], maxBins=t["bins"], maxDepth=self.depth, seed=self.seed)

    def _params(self) -> dict:
        return dict(kind=self.kind, n_splits=self.n_splits, seed=self.seed, class_weight=self.class_weight,
                    rounds=self.rounds, depth=self.depth, step=self.step, workers=self.workers, **self.trees)

    def _joint(self) -> Settings:
        t = self.trees
        return Settings(self.rounds, self.depth, self.step, t["bins"], t["ridge"], t["child_weight"], self.class_weight == "balanced")

    def _fitted(self) -> list[str]:
        if not self.models:
            raise RuntimeError("the classifier is not fitted")
        return self.classes

    def _assembled(self, df: DataFrame) -> DataFrame:
        # plain names: the assembler does not take quoted column names
        fed = df.withColumns({f"_f{i}": named(f).cast("double") for i, f in enumerate(self.features)})
        inputs = [f"_f{i}" for i in range(len(self.features))]
        return VectorAssembler(inputCols=inputs, outputCol="_features").transform(fed).drop(*inputs)

    def _labelled(self, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
        self.features = list(features)
        shared_folder(df.sparkSession)
        coded, self.classes = encode_labels(df.filter(named(label).isNotNull()), label, "_code")
        return coded

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "TopicClassifier":
        labelled = self._labelled(df, features, label)
        if self.kind == "boosted":
            fed = cached(labelled.select("_code", *[named(f) for f in features]))
            try:
                self.models = fit_jointly(fed, features, "_code", len(self.classes), [(0, len(features), -1)], self._joint())
            finally:
                fed.unpersist()
            return self
        if self.class_weight == "balanced":
            labelled = balanced_weights(labelled, label, "_weight")
        else:
            labelled = labelled.withColumn("_weight", F.lit(1.0))
        fed = cached(self._assembled(labelled).select("_features", F.col("_code").cast("double").alias("_code"), "_weight"))
        try:
            forest = RandomForestClassifier(featuresCol="_features", labelCol="_code", weightCol="_weight", numTrees=self.rounds, **self._engine())
            self.models = [forest.fit(fed)]
        finally:
            fed.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``P(class)`` and ``DX_pred``; a map over rows, no shuffle."""
        classes = self._fitted()
        if self.kind == "boosted":
            return with_prediction(map_rows(df, self.features, self.models[0].probabilities, [f"P({c})" for c in classes]), classes)
        model = self.models[0]
        model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_vector")
        scored = model.transform(self._assembled(df)).withColumn("_p", vector_to_array("_vector"))
        return with_prediction(
            scored.select(*[named(c) for c in df.columns], *[F.get("_p", F.lit(k)).alias(f"P({c})") for k, c in enumerate(classes)]), classes
        )

    def cross_validate(self, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str]) -> DataFrame:
        """Out-of-fold predictions over stratified folds; boosted trees of all folds grow in common passes."""
        if self.kind == "forest":
            fit = lambda part: TopicClassifier(**self._params()).fit(part, features, label)
            return out_of_fold(df, features, label, ids, fit, self.n_splits, self.seed, workers=self.workers)
        return cross_validate_jointly([self], df, [features], label, ids)[0]

    def fit_and_cross_validate(self, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str]) -> DataFrame:
        """Fit on all rows and return out-of-fold predictions; for boosted trees in the same passes."""
        if self.kind == "forest":
            return self.fit(df, features, label).cross_validate(df, features, label, ids)
        return cross_validate_jointly([self], df, [features], label, ids, fit_whole=True)[0]

    def report(self, predictions: DataFrame, classes: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """Accuracy, confusion counts and per-class report."""
        classes = list(classes or self.classes or [])
        return {
            "accuracy": accuracy(predictions, "DX_true", "DX_pred"),
            "confusion": confusion_counts(predictions, "DX_true", "DX_pred", classes),
            "report": classification_report(predictions, "DX_true", "DX_pred", classes),
        }

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), largest first: mean gain per split of boosted trees, the forest's own measure else; sums to 1."""
        self._fitted()
        model = self.models[0]
        values = model.importance() if self.kind == "boosted" else model.featureImportances.toArray()
        rows = sorted(zip(self.features, map(float, values)), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        classes, held = self._fitted(), {}
        if self.kind == "forest":
            self.models[0].write().overwrite().save(f"{path}/model_0")
        else:
            held = {k: v.tolist() for k, v in vars(self.models[0]).items() if isinstance(v, np.ndarray)}
            held["cuts"] = [c.tolist() for c in self.models[0].cuts]
            held["losses"] = self.models[0].losses
        write_json(spark, f"{path}/params", dict(self._params(), features=self.features, classes=classes, trees=held))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TopicClassifier":
        p = read_json(spark, f"{path}/params")
        features, classes, held = p.pop("features"), p.pop("classes"), p.pop("trees")
        model = cls(**p)
        model.features, model.classes = features, classes
        if model.kind == "forest":
            model.models = [RandomForestClassificationModel.load(f"{path}/model_0")]
        else:
            arrays = {k: np.array(v) for k, v in held.items() if k not in ("cuts", "losses")}
            model.models = [Trees([np.array(c, dtype=np.float64) for c in held["cuts"]], losses=held["losses"], **arrays)]
        return model


def with_prediction(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add ``DX_pred``, the first class of the largest probability."""
    p = F.array(*[named(f"P({c})") for c in classes])
    return df.withColumn("DX_pred", F.get(F.lit(list(classes)), (F.array_position(p, F.array_max(p)) - 1).cast("int")))


def cross_validate_jointly(classifiers: Sequence[TopicClassifier], df: DataFrame, blocks: Sequence[Sequence[str]], label: str,
                           ids: Sequence[str], fit_whole: bool = False) -> list[DataFrame]:
    """Out-of-fold predictions of several boosted classifiers, each on its own feature columns of the same rows.

    All training sets of all classifiers grow their trees in common passes; their settings must be alike. With
    ``fit_whole`` each classifier is also fitted on all rows.
    """
    first = classifiers[0]
    if any(c._params() != first._params() or c.kind != "boosted" for c in classifiers):
        raise ValueError("joint folds need boosted classifiers with equal settings")
    features = [f for block in blocks for f in block]
    folded = folded_rows(df, features, label, ids, first.n_splits, first.seed)
    coded = first._labelled(folded, blocks[0], label)
    folds, models, lo = range(first.n_splits), [], 0
    for block in blocks:
        models += [(lo, lo + len(block), f) for f in [*folds, *([-1] if fit_whole else [])]]
        lo += len(block)
    fed = cached(coded.selectExpr("_code", "fold", *[quoted(f) for f in features]))
    try:
        fitted = fit_jointly(fed, features, "_code", len(first.classes), models, first._joint(), "fold")
    finally:
        fed.unpersist()
    found, each = [], len(folds) + fit_whole
    for k, (classifier, block) in enumerate(zip(classifiers, blocks)):
        classifier.features, classifier.classes = list(block), first.classes
        of_folds = fitted[k * each:k * each + len(folds)]
        if fit_whole:
            classifier.models = [fitted[k * each + len(folds)]]
        mine = folded.selectExpr(*[quoted(c) for c in dict.fromkeys([*ids, label, "fold", *block])])
        scored = map_rows(mine, [*block, "fold"], held_out(of_folds), [f"P({c})" for c in first.classes])
        found.append(shown_predictions(with_prediction(scored, first.classes), label, ids))
    return found


def held_out(models: Sequence[Trees]):
    """Probabilities of rows whose last column is their fold, from the model that didn't see it."""
    def step(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), models[0].feature.shape[1]))
        for f, model in enumerate(models):
            mine = x[:, -1] == f
            if mine.any():
                out[mine] = model.probabilities(x[mine, :-1])
        return out

    return step
