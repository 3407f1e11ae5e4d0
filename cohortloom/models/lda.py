"""Latent Dirichlet allocation by batch variational Bayes on Spark.

One Spark job per iteration: the topic parameters (topics x features) sit on
the driver, tasks compute the row posteriors of their blocks and send back
sums of the same size. Blocks stay in memory as matrices between iterations.
Several models, such as the topic counts of a sweep, are fitted in the same
iterations (``fit_topics``). Where the rows are few enough for one task, each
model makes all its iterations in a task of its own.
Follows Blei, Ng and Jordan (2003) and Hoffman, Blei and Bach (2010); inputs
may be fractional.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cohortloom.functions.rowwise import named
from cohortloom.models import kernels
from cohortloom.models.common import (
    fit_input,
    map_rows,
    matrix_input,
    read_json,
    read_matrix,
    sum_over_rows,
    write_json,
    write_matrix,
)
from cohortloom.models.resident import Resident
from cohortloom.operators.aggregates import group_means
from cohortloom.operators.ranking import top_per_group
from cohortloom.operators.topics import pattern_frame, pattern_wide, subject_topic_table, topic_names


#: Most bytes of rows that a task holds to fit a model on its own.
ALONE_BYTES = 32 << 20
#: What a job costs, counted in (row, feature, topic) cells of a pass; a feature costs as much as ``FEATURE_CELLS`` topics besides.
JOB_CELLS = 2_500_000
FEATURE_CELLS = 8


class TopicModel:
    """Topics over a block of non-negative features.

    ``tol`` ends the fit once the mean relative change of the topic
    parameters falls below it; 0 always runs ``max_iter`` passes. A row's
    posterior takes up to ``posterior_steps`` steps, or stops when they move
    less than ``posterior_tol``; with ``warm`` it goes on from the iteration
    before instead of from ones, which takes fewer steps but may end in another, worse optimum. After a fit ``n_iter_`` has the passes made,
    ``converged_`` whether ``tol`` was reached. Missing or negative values are
    refused.
    """

    def __init__(
        self,
        n_topics: int = 6,
        alpha: float = 1.0,
        beta: float = 0.1,
        max_iter: int = 500,
        seed: int = 42,
        tol: float = 0.0,
        posterior_steps: int = 100,
        posterior_tol: float = 1e-3,
        warm: bool = False,
    ):
        self.n_topics, self.alpha, self.beta = n_topics, float(alpha), float(beta)
        self.max_iter, self.seed, self.tol = max_iter, seed, tol
        self.posterior_steps, self.posterior_tol, self.warm = posterior_steps, posterior_tol, warm
        self.features: list[str] | None = None
        self.components: np.ndarray | None = None
        self.perplexity_: float | None = None
        self.n_iter_, self.converged_ = 0, False
        self.mass_: list[float] = []

    def _fitted(self) -> np.ndarray:
        if self.components is None:
            raise RuntimeError("the topic model is not fitted")
        return self.components

    def fit(self, df: DataFrame, features: Sequence[str], with_perplexity: bool = True) -> "TopicModel":
        fit_topics(df, features, [self], with_perplexity)
        return self

    def _bound(self):
        """A step that adds up the rows' part of the bound and the mass, and what turns the sums into the perplexity."""
        lam, alpha, settle = self._fitted(), self.alpha, (self.posterior_steps, self.posterior_tol)
        word_log = kernels.dirichlet_log_mean(lam)
        word = np.exp(word_log)

        def rows(m):
            return np.array([kernels.topic_bound(m, word_log, word, alpha, *settle), m.sum()])

        def perplexity(bound: float, mass: float) -> float:
            eta, width = self.beta, lam.shape[1]
            bound += float(((eta - lam) * word_log).sum())
            bound += float((kernels.log_gamma(lam) - kernels.log_gamma(np.full_like(lam, eta))).sum())
            row = kernels.log_gamma(np.full(len(lam), eta * width)) - kernels.log_gamma(lam.sum(axis=1))
            bound += float(row.sum())
            return float(np.exp(-bound / mass))

        return rows, perplexity

    def perplexity(self, df: DataFrame) -> float:
        rows, perplexity = self._bound()
        return perplexity(*sum_over_rows(matrix_input(df, self.features or []), 2, rows))

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        """Add ``Topic_k`` weights (rows sum to 1); the topics stay fixed."""
        return map_rows(df, features or self.features, self.weights_step(), self.topics)

    def weights_step(self):
        """The step that turns rows into weights; it carries the topics only."""
        lam, alpha, settle = self._fitted(), self.alpha, (self.posterior_steps, self.posterior_tol)
        word = np.exp(kernels.dirichlet_log_mean(lam))

        def weights(m):
            gamma = kernels.topic_posterior(m, word, alpha, *settle)
            return gamma / gamma.sum(axis=1, keepdims=True)

        return weights

    @property
    def topics(self) -> list[str]:
        return topic_names(self.n_topics)

    def normalised(self) -> np.ndarray:
        lam = self._fitted()
        return lam / lam.sum(axis=1, keepdims=True)

    def patterns(self, spark: SparkSession, normalised: bool = True) -> DataFrame:
        """Long (topic, pos, feature, weight) table."""
        return pattern_frame(spark, self.normalised() if normalised else self._fitted(), self.features)

    def pattern_table(self, spark: SparkSession) -> DataFrame:
        """One row per feature, one column per topic."""
        return pattern_wide(self.patterns(spark), self.n_topics).orderBy("pos")

    def top_features(self, spark: SparkSession, n: int = 10) -> DataFrame:
        return top_per_group(self.patterns(spark), "topic", "weight", "pos", n)

    def subject_table(self, weights: DataFrame, ids: Sequence[str], label: str) -> DataFrame:
        return subject_topic_table(weights, ids, label, self.n_topics)

    def group_table(self, weights: DataFrame, label: str) -> DataFrame:
        return group_means(weights.filter(named(label).isNotNull()), label, self.topics)

    def save(self, spark: SparkSession, path: str) -> None:
        write_matrix(spark, f"{path}/components", self._fitted())
        params = dict(n_topics=self.n_topics, alpha=self.alpha, beta=self.beta, max_iter=self.max_iter,
                      seed=self.seed, tol=self.tol, features=self.features, perplexity=self.perplexity_,
                      n_iter=self.n_iter_, converged=self.converged_, posterior_steps=self.posterior_steps,
                      posterior_tol=self.posterior_tol, warm=self.warm)
        write_json(spark, f"{path}/params", params)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TopicModel":
        p = read_json(spark, f"{path}/params")
        model = cls(p["n_topics"], p["alpha"], p["beta"], p["max_iter"], p["seed"], p["tol"],
                    p["posterior_steps"], p["posterior_tol"], p["warm"])
        model.features, model.perplexity_ = p["features"], p["perplexity"]
        model.n_iter_, model.converged_ = p["n_iter"], p["converged"]
        model.components = read_matrix(spark, f"{path}/components")
        return model


def _alone(rows: int, features: int, topics: Sequence[int], cores: int) -> bool:
    """Whether models fitted in a task each are done no later than in common passes, each a job that the cores share."""
    if not rows or 8 * rows * features > ALONE_BYTES:
        return False
    cells = sorted((rows * features * (k + FEATURE_CELLS) for k in topics), reverse=True)
    busy = [0] * cores
    for c in cells:
        busy[busy.index(min(busy))] += c
    return max(busy) <= sum(cells) / cores + JOB_CELLS


def fit_topics(df: DataFrame, features: Sequence[str], models: Sequence[TopicModel], with_perplexity: bool = True) -> Sequence[TopicModel]:
    """Fit all models in the same passes over the rows; a model that has converged or made its passes drops out.

    The models must agree on how posteriors settle. One pass is one job, whatever the number of models; models of few rows make
    all passes in one job instead, each in its own task.
    """
    settle = {(m.posterior_steps, m.posterior_tol, m.warm) for m in models}
    if len(settle) > 1:
        raise ValueError("models that are fitted together need equal posterior settings")
    warm = any(m.warm for m in models)
    x = fit_input(df, features, nonnegative=True)
    lam = {}
    for k, m in enumerate(models):
        m.features, m.mass_, m.n_iter_, m.converged_ = list(features), [], 0, False
        lam[k] = np.random.RandomState(m.seed).gamma(100.0, 0.01, (m.n_topics, len(m.features)))
    alphas = {k: m.alpha for k, m in enumerate(models)}
    state = Resident(x, kernels.topic_block)
    try:
        if _alone(x.count(), len(features), [m.n_topics for m in models], df.sparkSession.sparkContext.defaultParallelism):
            # the largest begin first
            order = sorted(lam, key=lambda k: -models[k].n_topics)
            fits = [(lam[k], m.alpha, m.beta, m.max_iter, m.tol, next(iter(settle))) for k, m in ((k, models[k]) for k in order)]
            found = state.apart(len(fits), lambda i, blocks: kernels.topic_fit(np.concatenate([b["x"] for b in blocks]), *fits[i]))
            for i, (made, done, mass) in found.items():
                m = models[order[i]]
                lam[order[i]], m.converged_, m.mass_, m.n_iter_ = made, done, mass, len(mass)
        # what is left where the rows are too many: passes of all models
        while True:
            active = [k for k, m in enumerate(models) if not m.converged_ and m.n_iter_ < m.max_iter]
            if not active:
                break
            words = {k: np.exp(kernels.dirichlet_log_mean(lam[k])) for k in active}
            step, size = kernels.topic_pass(words, alphas, *next(iter(settle))), sum(lam[k].size for k in active)
            if warm:
                state.advance(step)
                flat = state.total(kernels.topic_sums, size)
            else:
                # nothing is carried from pass to pass, so the blocks stay as they are
                flat = state.total(lambda block, step=step: kernels.topic_sums(step(block)), size)
            at = 0
            for k in active:
                m, size = models[k], lam[k].size
                lam[k], m.converged_ = kernels.topic_update(lam[k], flat[at:at + size], m.beta, m.tol)
                at += size
                m.n_iter_ += 1
                m.mass_.append(float(lam[k].sum()))
        for k, m in enumerate(models):
            m.components = lam[k]
        if with_perplexity:
            bounds = [m._bound() for m in models]
            steps = [rows for rows, _ in bounds]
            sums = state.total(lambda block: np.concatenate([rows(block["x"]) for rows in steps]), 2 * len(models))
            for k, (m, (_, perplexity)) in enumerate(zip(models, bounds)):
                m.perplexity_ = perplexity(*sums[2 * k:2 * k + 2])
    finally:
        state.drop()
        x.unpersist()
    return models
