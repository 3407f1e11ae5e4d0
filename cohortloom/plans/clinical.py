"""Clinical table preparation: joins, flags, combinations and stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import (
    argmax_label,
    discordance,
    encode_with,
    joined_labels,
    label_count,
    named,
    threshold_stage,
    tidy_text,
    weighted_mean,
)
from cohortloom.functions.rules import COMBINATION_FLAGS, with_clinical_flags
from cohortloom.models.mixture import mixture_scores
from cohortloom.operators.joins import fill_from_lookup, merge

# Join keys of the clinical tables and the columns to fill.
VISIT_KEYS = ("NACCID", "NACCVNUM")
DEMOGRAPHICS = ("NACCAGEB", "NACCAGE", "SEX", "EDUC", "NACCMMSE", "NACCNE4S")

# Atlas labels of the two staging areas (1008 is listed twice)
# and the tau column of every label.
MEDIAL_LABELS = (1006, 2006)
NEOCORTEX_LABELS = (1008, 1008, 1010, 1015, 1023, 2008, 2009, 2010, 2015, 2023)
TAU_COLUMNS = {
    1006: "TAU/CTX_LH_ENTORHINAL_SUVR",
    2006: "TAU/CTX_RH_ENTORHINAL_SUVR",
    1008: "TAU/CTX_LH_INFERIORPARIETAL_SUVR",
    2008: "TAU/CTX_RH_INFERIORPARIETAL_SUVR",
    1009: "TAU/CTX_LH_INFERIORTEMPORAL_SUVR",
    2009: "TAU/CTX_RH_INFERIORTEMPORAL_SUVR",
    1010: "TAU/CTX_LH_ISTHMUSCINGULATE_SUVR",
    2010: "TAU/CTX_RH_ISTHMUSCINGULATE_SUVR",
    1015: "TAU/CTX_LH_MIDDLETEMPORAL_SUVR",
    2015: "TAU/CTX_RH_MIDDLETEMPORAL_SUVR",
    1023: "TAU/CTX_LH_POSTERIORCINGULATE_SUVR",
    2023: "TAU/CTX_RH_POSTERIORCINGULATE_SUVR",
}

STAGES = {"low": 0, "mid": 1, "high": 2}


def prepare_clinical(images: DataFrame, clinical: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Join, flag, fill demographics, and add the label combination.

    ``order`` says which clinical row counts as a visit's first.
    """
    keys = [*VISIT_KEYS, *DEMOGRAPHICS]
    merged = merge(images, clinical, keys, "left", null_safe=True)
    flagged = with_clinical_flags(merged)
    filled = fill_from_lookup(flagged, clinical, VISIT_KEYS, DEMOGRAPHICS, order)
    return with_combination(filled, COMBINATION_FLAGS)


def with_combination(df: DataFrame, flags: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Add ``combination`` (joined labels) and ``n_labels``."""
    df = df.withColumn("combination", joined_labels(flags))
    return df.withColumn("n_labels", label_count(F.col("combination")))


def with_stage_scores(df: DataFrame, cell_counts: Mapping[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Weighted area means, their mixture scores and the observed stage.

    With ``by`` each cohort has its own mixtures; those of both areas and all cohorts are fitted together.
    """
    for out, labels in (("MTL", MEDIAL_LABELS), ("NEO", NEOCORTEX_LABELS)):
        pairs = [(TAU_COLUMNS[v], float(cell_counts[v])) for v in labels]
        df = df.withColumn(f"TAU/{out}_SUVR", weighted_mean(pairs, df.columns))
    df = mixture_scores(df, {f"TAU/{out}_SUVR": f"TAU/{out}_Z" for out in ("MTL", "NEO")}, by)
    return df.withColumn("TAU/stage_aa_gt", threshold_stage(named("TAU/MTL_Z"), named("TAU/NEO_Z")))


def with_discordance(
    df: DataFrame,
    predicted: Sequence[str],
    predicted_prefix: str,
    observed: Column,
    labels: tuple[str, str, str] = ("Overpredict", "Canonical", "Underpredict"),
) -> DataFrame:
    """Predicted stage, both codes and the predicted-versus-observed class."""
    stage = tidy_text(argmax_label(predicted, predicted_prefix))
    coded = df.withColumns(
        {
            "pred_stage": stage,
            "obs_stage": tidy_text(observed),
        }
    ).withColumns(
        {"pred_code": encode_with(F.col("pred_stage"), STAGES), "obs_code": encode_with(F.col("obs_stage"), STAGES)}
    )
    return coded.withColumn("stage_group", discordance(F.col("pred_code"), F.col("obs_code"), *labels))
