"""Coded clinical columns turned into 0/1 flags by a declarative rule table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import quoted


@dataclass(frozen=True)
class FlagRule:
    """``flag`` is 1 when any code column holds one of ``values``.

    ``staged`` also asks for the stage column to hold the demented code;
    ``cause`` marks the flag as a named cause for the fallback rule.
    """

    flag: str
    codes: tuple[str, ...]
    values: tuple[int, ...] = (1, 2)
    staged: bool = True
    cause: bool = False


# The coded input columns and the flags they set, in output order.
STAGE_COLUMN = "NACCUDSD"
DEMENTED = 4
STAGE_FLAGS = (("NC", 1), ("IMCI", 2), ("MCI", 3), ("DE", 4))
CAUSE_RULES = (
    FlagRule("AD", ("NACCALZP",), cause=True),
    FlagRule("PD", ("PARK",), values=(1,), staged=False),
    FlagRule("LBD", ("NACCLBDP",), cause=True),
    FlagRule("VD", ("CVDIF", "VASCIF", "VASCPSIF", "STROKIF"), cause=True),
    FlagRule("SVAD", ("SIVDFIND",), values=(1,), staged=False),
    FlagRule("PCA", ("PCA",), values=(1,), staged=False),
    FlagRule("PRD", ("PRIONIF",), cause=True),
    FlagRule("FTD_ANY", ("FTLDNOIF", "FTDIF", "FTLDMOIF", "PPAPHIF", "PSPIF", "CORTIF"), cause=True),
    FlagRule("bvFTD", ("FTDIF",)),
    FlagRule("PPA_ANY", ("PPAPHIF",)),
)
SUBTYPE_COLUMN = "NACCPPME"
SUBTYPE_FLAGS = (("nfvPPA", 1), ("svPPA", 2))
LATER_RULES = (
    FlagRule("NPH", ("HYCEPHIF",), cause=True),
    FlagRule("SEF", ("OTHCOGIF", "HIVIF", "ALCDEMIF", "IMPSUBIF", "DYSILLIF", "MEDSIF", "DELIRIF"), cause=True),
    FlagRule("PSY", ("DEPIF", "BIPOLDIF", "SCHIZOIF", "ANXIETIF", "PTSDDXIF", "OTHPSYIF"), cause=True),
    FlagRule("TBI", ("BRNINJIF",), cause=True),
)
FALLBACK_FLAG = "ODE"
FALLBACK_CODES = (
    "MSAIF", "ESSTREIF", "DOWNSIF", "HUNTIF", "EPILEPIF",
    "NEOPIF", "DEMUNIF", "COGOTHIF", "COGOTH2F", "COGOTH3F",
)
# Flags that go into the combination text, in order (``DE`` is left out).
COMBINATION_FLAGS = ("NC", "IMCI", "MCI", "AD", "PD", "LBD", "VD", "SVAD", "PCA", "PRD", "FTD_ANY")


def code_columns() -> list[str]:
    """All coded input columns the clinical rules read."""
    seen = [STAGE_COLUMN]
    for rule in CAUSE_RULES + LATER_RULES:
        seen.extend(rule.codes)
    seen.append(SUBTYPE_COLUMN)
    seen.extend(FALLBACK_CODES)
    return list(dict.fromkeys(seen))


def any_code(codes: Sequence[str], values: Sequence[int]) -> str:
    """SQL text: any code column holds one of the values; null is no."""
    listed = ", ".join(str(v) for v in values)
    return "(" + " OR ".join(f"coalesce({quoted(c)} IN ({listed}), false)" for c in codes) + ")"


def clinical_flags(fill_zero: bool = False) -> dict[str, Column]:
    """The flag columns of the clinical rule table, in output order.

    The two-way subtype sets only one of its flags for codes 1 and 2 and
    leaves the other missing; ``fill_zero`` writes 0 there instead.
    """
    stage = quoted(STAGE_COLUMN)
    demented = f"coalesce({stage} = {DEMENTED}, false)"

    def condition(rule: FlagRule) -> str:
        met = any_code(rule.codes, rule.values)
        return f"({met} AND {demented})" if rule.staged else met

    texts = {flag: f"coalesce({stage} = {code}, false)" for flag, code in STAGE_FLAGS}
    texts |= {rule.flag: condition(rule) for rule in CAUSE_RULES}
    flags = {flag: F.expr(f"CAST({text} AS INT)") for flag, text in texts.items()}
    subtype = quoted(SUBTYPE_COLUMN)
    for flag, code in SUBTYPE_FLAGS:
        others = ", ".join(str(c) for _, c in SUBTYPE_FLAGS if c != code)
        missing = "0" if fill_zero else "NULL"
        flags[flag] = F.expr(f"CASE WHEN {subtype} = {code} THEN 1 WHEN {subtype} IN ({others}) THEN {missing} ELSE 0 END")
    flags |= {rule.flag: F.expr(f"CAST({condition(rule)} AS INT)") for rule in LATER_RULES}
    caused = " OR ".join(any_code(rule.codes, rule.values) for rule in CAUSE_RULES + LATER_RULES if rule.cause)
    other = any_code(FALLBACK_CODES, (1, 2))
    flags[FALLBACK_FLAG] = F.expr(f"CAST({demented} AND (NOT ({caused}) OR {other}) AS INT)")
    return flags


def with_clinical_flags(df: DataFrame, fill_zero: bool = False) -> DataFrame:
    """Add all flags; a code column that shares a flag's name is replaced."""
    return df.withColumns(clinical_flags(fill_zero))
