"""Row expressions over one or several columns; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str, table: str | None = None) -> Column:
    """Column by literal name, safe for ``/``, ``(``, ``)`` and ``.``."""
    return F.col(f"{table}.{quoted(name)}" if table else quoted(name))


def quoted(name: str) -> str:
    """SQL text of a column name.

    Wide feature blocks are written as SQL text: one expression per column
    costs one call to the JVM instead of one per operator.
    """
    return "`" + name.replace("`", "``") + "`"


def double_of(name: str) -> str:
    return f"CAST({quoted(name)} AS DOUBLE)"


def number(value: float) -> str:
    """SQL text of a double, exact to the last bit."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def clipped(value: str) -> str:
    """SQL text of ``max(value, 0)``: null stays null and NaN stays NaN."""
    return f"CASE WHEN {value} <= 0D THEN 0D ELSE {value} END"


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def lower_bound_zero(column: Column, flip: bool = False) -> Column:
    """``max(x, 0)`` or ``max(-x, 0)``; null stays null and NaN stays NaN."""
    value = -column if flip else column
    # NaN compares as larger than any number, so it takes the second branch
    return F.when(value <= 0.0, F.lit(0.0)).otherwise(value)


def invert(column: Column, ceiling: float) -> Column:
    return F.lit(float(ceiling)) - column


def log_invert(column: Column, ceiling: float) -> Column:
    return F.log1p(F.lit(float(ceiling)) - column)


def argmax_label(names: Sequence[str], strip: str = "", labels: Sequence[str] | None = None) -> Column:
    """Label of the first largest column; nulls and NaN are skipped."""
    shown = list(labels) if labels is not None else [n.replace(strip, "", 1) if strip else n for n in names]
    values = F.array(*[nan_to_null(named(n).cast("double")) for n in names])
    # a row without any value has a null maximum, hence a null place and label
    place = (F.array_position(values, F.array_max(values)) - 1).cast("int")
    return F.get(F.lit(shown), place)


def winner_flags(names: Sequence[str], suffix: str = "_winner") -> dict[str, Column]:
    """1 for every column equal to the row maximum (ties all 1), else 0.

    A row with a missing value has no maximum and gets 0 everywhere.
    """
    columns = [named(n).cast("double") for n in names]
    present = F.lit(True)
    for c in columns:
        present = present & c.isNotNull() & ~F.isnan(c)
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return {
        n + suffix: F.when(F.coalesce(present & (c == top), F.lit(False)), 1).otherwise(0)
        for n, c in zip(names, columns)
    }


def row_total(names: Sequence[str]) -> Column:
    """Sum of a column family; missing values count as zero."""
    return F.expr(" + ".join(f"coalesce(nanvl({double_of(n)}, 0D), 0D)" for n in names) or "0D")


def names_lacking(names: Sequence[str], text: str) -> list[str]:
    """Names without ``text`` anywhere in them (plain substring rule)."""
    return [n for n in names if text not in n]


def row_shares(names: Sequence[str], scale: float = 1.0) -> dict[str, Column]:
    """Every column divided by the row sum, times ``scale``."""
    total = " + ".join(double_of(n) for n in names)
    return {n: F.expr(f"try_divide({double_of(n)}, {total}) * {number(scale)}") for n in names}


def tidy_text(column: Column) -> Column:
    return F.lower(F.trim(column.cast("string")))


def encode_with(column: Column, codes: Mapping[str, int]) -> Column:
    """Code of a value; unknown or missing values give null.

    A map lookup reads the column once, so stacked codes do not multiply
    the expression the way nested CASE branches would.
    """
    entries = [F.lit(part) for pair in codes.items() for part in pair]
    return F.element_at(F.create_map(*entries), column.cast("string"))


def discordance(
    predicted: Column,
    observed: Column,
    above: str = "Overpredict",
    equal: str = "Canonical",
    below: str = "Underpredict",
) -> Column:
    """Compare two ordinal codes; null on either side gives null."""
    place = (F.signum(predicted - observed) + 1).cast("int")
    return F.get(F.lit([below, equal, above]), place)


def threshold_stage(first: Column, second: Column, cut: float = 2.0) -> Column:
    """low / mid / high from two scores; ``high`` needs only the second."""
    first, second = nan_to_null(first), nan_to_null(second)
    return (
        F.when((first < cut) & (second < cut), "low")
        .when((first >= cut) & (second < cut), "mid")
        .when(second >= cut, "high")
    )


def collapse_labels(column: Column, keep: Sequence[str], other: str) -> Column:
    """Keep listed labels, name all others (and missing) ``other``."""
    return F.when(column.isin(*keep), column).otherwise(F.lit(other))


def swap_value(column: Column, old: str, new: str) -> Column:
    return F.when(column == old, F.lit(new)).otherwise(column)


def swap_text(column: Column, old: str, new: str) -> Column:
    """Literal substring replacement."""
    return F.replace(column, F.lit(old), F.lit(new))


def text_part(column: Column, delimiter: str, part: int) -> Column:
    """1-based part of a delimited text; negative counts from the end."""
    return F.split_part(column, F.lit(delimiter), F.lit(part))


def joined_labels(flags: Mapping[str, str] | Sequence[str], delimiter: str = "+") -> Column:
    """Names of the set flags in the given order; none set gives null."""
    pairs = flags.items() if isinstance(flags, Mapping) else [(f, f) for f in flags]
    parts = [F.when(named(column) == 1, F.lit(label)) for column, label in pairs]
    return F.nullif(F.concat_ws(delimiter, *parts), F.lit(""))


def label_count(column: Column, delimiter: str = "+") -> Column:
    """Number of labels in a joined text; null stays null."""
    return F.when(column.isNotNull(), F.size(F.split(column, "\\Q" + delimiter + "\\E")))


def probability_of(label: Column, classes: Sequence[str], prefix: str = "P(", suffix: str = ")") -> Column:
    """The probability column that belongs to the row's own label."""
    entries = [part for c in classes for part in (F.lit(c), named(f"{prefix}{c}{suffix}"))]
    return F.element_at(F.create_map(*entries), label.cast("string"))


def order_index(column: Column, order: Sequence[str]) -> Column:
    """Position in an ordered category list; other values give null."""
    return encode_with(column, {v: i for i, v in enumerate(order)})


def one_hot(column: Column, values: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{v}": F.coalesce((column == v).cast("int"), F.lit(0)) for v in values}


def weighted_mean(weights: Sequence[tuple[str, float]], present: Sequence[str]) -> Column:
    """``sum(w*x)/sum(w)`` over the listed columns that exist.

    A column listed twice counts twice, a missing value makes the mean null,
    and so does a list of which no column exists.
    """
    have = set(present)
    used = [(n, float(w)) for n, w in weights if n in have]
    if not used:
        return F.lit(None).cast("double")
    top = F.lit(0.0)
    for n, w in used:
        top = top + nan_to_null(named(n).cast("double")) * F.lit(w)
    return top / F.lit(sum(w for _, w in used))


def stars(p: Column) -> Column:
    """Star code of a p value; null when not significant.

    Fixed values: **** 1e-4, *** 1e-3, ** 1e-2, * 5e-2.
    """
    return (
        F.when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 1e-2, "**").when(p <= 5e-2, "*")
    )
