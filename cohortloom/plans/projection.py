"""Pattern-weighted class scores of a cohort and the tests between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, swap_value
from cohortloom.operators.baseline import Baseline
from cohortloom.operators.filters import drop_incomplete, exclude_matching, split_reference
from cohortloom.operators.stats import adjust_bh, paired_tests, significant_only
from cohortloom.operators.topics import project_classes, weighted_top_scores


def class_scores(
    df: DataFrame,
    features: Sequence[str],
    patterns: DataFrame,
    class_weights: DataFrame,
    label: str = "DX",
    reference: str = "CN",
    combination: str = "combination",
    drop_pattern: str = "NC|MCI|iMCI",
    renamed: tuple[str, str] = ("NC+PD", "PD"),
    top: int = 10,
) -> DataFrame:
    """Add ``<feature>_ND`` scores, topic scores and ``ND_<class>``.

    The baseline is taken before any row is filtered out.
    """
    own, _ = split_reference(df, label, reference)
    baseline = Baseline.fit(own, features)
    kept = df.withColumn(combination, swap_value(named(combination), *renamed))
    kept = drop_incomplete(exclude_matching(kept, combination, drop_pattern), [combination])
    scored = kept.withColumns({f"{n}_ND": c for n, c in baseline.columns().items()})
    topics = [c for c in class_weights.columns if c.startswith("Topic_")]
    scored = weighted_top_scores(scored, patterns, top)
    names = [f"{t}_top10_weighted_z" for t in topics]
    missing = [n for n in names if n not in scored.columns]
    scored = scored.withColumns({n: F.lit(0.0) for n in missing}) if missing else scored
    return project_classes(scored, class_weights, "DX", topics, names)


def class_score_tests(
    scored: DataFrame, combination: str = "combination", prefix: str = "ND_", significant: bool = True
) -> DataFrame:
    """Paired differences of class scores within combinations, adjusted.

    Only significant ones with their star code unless asked for all.
    """
    names = [c for c in scored.columns if c.startswith(prefix)]
    tests = adjust_bh(paired_tests(scored, combination, names), [combination], ["first", "second"])
    return significant_only(tests) if significant else tests
