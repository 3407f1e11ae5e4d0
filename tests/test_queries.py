"""Queries with SQL match it, and queries without run, as far as they take seconds.

Queries that start from a full topic or tree fit take minutes each: ``python -m tests.oracle`` runs them, and
``tests/test_models.py`` holds their fits to their invariants.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, duck

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


# a full topic or tree fit stands before these; the comparison by ``tests.oracle`` has them
LONG = {"ml1b_topic_mass_per_feature", "io10c_stored_topics_agree", "io11b_stored_classifier_agrees",
        "ml11b_rows_of_out_of_fold_predictions"}


@pytest.mark.parametrize("name", [n for n in queries() if n in SQL and n not in LONG])
def test_query_matches_sql(spark, con, sf_dir, name):
    state, note = compare(spark, con, sf_dir, queries()[name], SQL[name])
    assert state == "ok", note


QUICK = {
    "ml4_factor_fit_patterns": 4 * 64,
    "ml4b_factor_weights_of_new_rows": None,
    "io10b_factor_model_store": None,
    "ml5_two_component_mixture": 2,
    "ml6_component_scores": None,
    "ml6b_component_loadings": 64,
    "sc34_mixture_score": None,
    "clinical_stage_scores": None,
    "class_score_projection_and_tests": 6,
}


@pytest.mark.parametrize("name", list(QUICK))
def test_query_without_sql(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).toArrow()
    assert got.num_rows == QUICK[name] if QUICK[name] else got.num_rows > 0
    for column in got.columns:
        if str(column.type) == "double":
            values = [v for v in column.to_pylist() if v is not None]
            assert all(v == v and abs(v) < float("inf") for v in values)


def test_entry(spark):
    assert entry(spark).count() == 50


def test_sql_names_are_queries():
    assert set(SQL) <= set(queries())
