"""Cohort and latent-pattern analytics as PySpark DataFrame jobs."""

from cohortloom.models.boosted import TopicClassifier
from cohortloom.models.lda import TopicModel
from cohortloom.models.logistic import LogisticTopicClassifier
from cohortloom.models.nmf import FactorModel
from cohortloom.operators.baseline import Baseline, CohortBaselines
from cohortloom.plans.analysis import CohortModel, analyse_files

__all__ = [
    "Baseline",
    "CohortBaselines",
    "CohortModel",
    "FactorModel",
    "LogisticTopicClassifier",
    "TopicClassifier",
    "TopicModel",
    "analyse_files",
]
