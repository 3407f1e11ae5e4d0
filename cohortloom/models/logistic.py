"""Multinomial logistic regression on standardised topic weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named
from cohortloom.models.common import read_json, write_json
from cohortloom.models.crossval import folded_rows, shown_predictions
from cohortloom.models.newton import Softmax, fit_softmax, probabilities
from cohortloom.operators.evaluate import encode_labels


class LogisticTopicClassifier:
    """Population-scaled features, L2 penalty of weight one over all rows.

    Fits of all folds share their passes over the rows (``models/newton.py``). A row with a missing feature gets null
    predictions; a fit refuses it.
    """

    def __init__(self, n_splits: int = 5, seed: int = 42, max_iter: int = 1000):
        self.n_splits, self.seed, self.max_iter = n_splits, seed, max_iter
        self.features: list[str] | None = None
        self.classes: list[str] | None = None
        self.model: Softmax | None = None
        #: the models of the last cross-validation, by the fold left out
        self.fold_models: list[Softmax] = []

    def _fitted(self) -> Softmax:
        if self.model is None:
            raise RuntimeError("the classifier is not fitted")
        return self.model

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "LogisticTopicClassifier":
        self.features = list(features)
        labelled, self.classes = encode_labels(df.filter(named(label).isNotNull()), label, "_code")
        fed = labelled.select("_code", *[named(f) for f in features])
        (self.model,) = fit_softmax(fed, features, "_code", len(self.classes), models=[1], max_iter=self.max_iter)
        return self

    def _shown(self, df: DataFrame, raw: Column) -> DataFrame:
        scored = df.withColumn("_p", probabilities(self.features, len(self.classes), raw))
        top = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
        return scored.select(
            *[named(c) for c in df.columns],
            *[F.get("_p", F.lit(k)).alias(f"P({c})") for k, c in enumerate(self.classes)],
            F.get(F.lit(self.classes), top).alias("DX_pred"),
        )

    def predict(self, df: DataFrame) -> DataFrame:
        return self._shown(df, F.lit(self._fitted().raw()))

    def cross_validate(self, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str]) -> DataFrame:
        """One row per labelled row, predicted by the model that left its fold out."""
        return self._cross_validate(df, features, label, ids, False)

    def fit_and_cross_validate(self, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str]) -> DataFrame:
        """Fit on all rows and return out-of-fold predictions, in the same passes."""
        return self._cross_validate(df, features, label, ids, True)

    def _cross_validate(self, df, features, label, ids, whole: bool) -> DataFrame:
        folded = folded_rows(df, features, label, ids, self.n_splits, self.seed)
        predicting = self if whole else LogisticTopicClassifier(self.n_splits, self.seed, self.max_iter)
        predicting.features = list(features)
        coded, predicting.classes = encode_labels(folded, label, "_code")
        wanted = [*range(self.n_splits), *([self.n_splits] if whole else [])]
        fed = coded.select("_code", "fold", *[named(f) for f in features])
        found = fit_softmax(fed, features, "_code", len(predicting.classes), "fold", self.n_splits, wanted, self.max_iter)
        self.fold_models = found[: self.n_splits]
        if whole:
            self.model = found[-1]
        # one map over the rows: each takes the weights of its own fold's model
        raw = F.get(F.array(*[F.lit(m.raw()) for m in self.fold_models]), F.col("fold"))
        return shown_predictions(predicting._shown(folded, raw), label, ids)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """One row per class, one column per feature."""
        model = self._fitted()
        schema = "DX string, " + ", ".join(f"`{f}` double" for f in self.features)
        return spark.createDataFrame([(c, *model.coefficients[k]) for k, c in enumerate(self.classes)], schema)

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, f"{path}/params", dict(n_splits=self.n_splits, seed=self.seed, max_iter=self.max_iter,
                                                 features=self.features, classes=self.classes,
                                                 model=self._fitted().to_dict()))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LogisticTopicClassifier":
        p = read_json(spark, f"{path}/params")
        out = cls(p["n_splits"], p["seed"], p["max_iter"])
        out.features, out.classes, out.model = p["features"], p["classes"], Softmax(**p["model"])
        return out
