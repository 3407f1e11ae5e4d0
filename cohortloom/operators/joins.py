"""Joins with pandas-like key, suffix and fill rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null
from cohortloom.runtime import join_small


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the stated order (missing keys form one key).

    The rank-1 filter is applied before the shuffle too, so copies of a hot
    key shrink to one row per task.
    """
    window = W.partitionBy(*[named(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key occurs twice."""
    repeated = df.groupBy(*[named(k) for k in keys]).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key {list(keys)} is not unique: {repeated[0].asDict()}")
    return df


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | Sequence[tuple[str, str]],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
    unique_right: bool = False,
) -> DataFrame:
    """Equi-join keeping both key columns when their names differ.

    Column names on both sides get the suffixes; a join on equal names keeps
    one key column. ``null_safe`` lets missing keys match missing keys.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    if unique_right:
        require_unique(right, [r for _, r in pairs])
    shared = {l for l, r in pairs if l == r}
    clash = (set(left.columns) & set(right.columns)) - shared
    l = left.select(*[named(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    key_alias = {r: f"_k{i}" for i, (_, r) in enumerate(pairs)}
    kept = [c for c in right.columns if c not in shared]
    r = right.select(
        *[named(k).alias(a) for k, a in key_alias.items()],
        *[named(c).alias(c + suffixes[1] if c in clash else c) for c in kept],
    )
    condition = None
    for lk, rk in pairs:
        lcol = named(lk + suffixes[0] if lk in clash else lk)
        rcol = F.col(key_alias[rk])
        part = lcol.eqNullSafe(rcol) if null_safe else lcol == rcol
        condition = part if condition is None else condition & part
    return l.join(r, condition, how).drop(*key_alias.values())


def absent_from(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in ``other``; missing keys stay."""
    keys = other.select(named(other_key or key).alias("_k")).filter("_k is not null").distinct()
    return df.join(keys, named(key) == F.col("_k"), "left_anti")


def present_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    # distinct shrinks copies of a hot key before they are shuffled
    keys = other.select(named(other_key or key).alias("_k")).filter("_k is not null").distinct()
    return df.join(keys, named(key) == F.col("_k"), "left_semi")


def fill_from_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], fill: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Fill missing values from the first lookup row with the same keys."""
    first = keep_first(lookup, keys, order).select(
        *[named(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[named(c).alias(f"_f{i}") for i, c in enumerate(fill)],
    )
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & named(k).eqNullSafe(F.col(f"_k{i}"))
    filled = {c: F.coalesce(named(c), F.col(f"_f{i}")) for i, c in enumerate(fill)}
    return df.join(first, match, "left").select(*[filled.get(c, named(c)).alias(c) for c in df.columns])


def patch_family(
    df: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str]], names: Sequence[str]
) -> DataFrame:
    """Add a column family from several sources, first non-missing wins."""
    out = df
    for s, (source, source_key) in enumerate(sources):
        side = source.select(
            named(source_key).cast("string").alias(f"_k{s}"),
            *[named(n).alias(f"_s{s}_{i}") for i, n in enumerate(names)],
        )
        out = out.join(side, named(key).cast("string") == F.col(f"_k{s}"), "left")
    patched = []
    for i, n in enumerate(names):
        options = [F.col(f"_s{s}_{i}") for s in range(len(sources))]
        options = [nan_to_null(o) if out.schema[f"_s{s}_{i}"].dataType.simpleString() in ("double", "float") else o
                   for s, o in enumerate(options)]
        patched.append(F.coalesce(*options).alias(n))
    return out.select(*[named(c) for c in df.columns if c not in names], *patched)


def map_labels(df: DataFrame, name: str, labels: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Replace a name by its label, keeping names that have none."""
    side = labels.select(named(key).cast("string").alias("_k"), named(value).cast("string").alias("_v"))
    return (
        join_small(df, side, named(name) == F.col("_k"), "left")
        .withColumn(out, F.coalesce(F.col("_v"), named(name).cast("string")))
        .drop("_k", "_v")
    )


def hemisphere_labels(table: DataFrame, region: str, left: str, right: str, prefix: str = "ctx") -> DataFrame:
    """Turn a (region, left label, right label) table into name -> label."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("lh").alias("hemi"), named(left).cast("string").alias("label")),
            F.struct(F.lit("rh").alias("hemi"), named(right).cast("string").alias("label")),
        )
    )
    return table.select(named(region), sides.alias("s")).select(
        F.concat_ws("_", F.lit(prefix), F.col("s.hemi"), named(region)).alias("name"), F.col("s.label").alias("label")
    )


def attach_predictions(raw: DataFrame, predictions: DataFrame, raw_key: str, key: str = "SUBJ_ID") -> DataFrame:
    """Left join of predictions onto the subject table, one row per subject."""
    return merge(raw, predictions, [(raw_key, key)], "left", suffixes=("", "_pred"), unique_right=True)


# Cortical slots (of 68) that belong to each lobe column.
LOBE_SLOTS: Mapping[str, Sequence[int]] = {
    "L_LT": (7, 13, 28, 0, 5, 32, 31, 14),
    "R_LT": (41, 47, 62, 34, 39, 66, 65, 48),
    "L_MT": (4,),
    "R_MT": (38,),
    "L_FRONTAL": (26, 25, 2, 16, 18, 17, 10, 12, 22, 15, 30, 24, 1),
    "R_FRONTAL": (60, 59, 36, 50, 52, 51, 44, 46, 56, 49, 64, 58, 35),
    "L_OCCIPITAL": (9, 11, 3, 19),
    "R_OCCIPITAL": (43, 45, 37, 53),
    "L_PARIETAL": (27, 6, 29, 20, 23, 21, 8),
    "R_PARIETAL": (61, 40, 63, 54, 57, 55, 42),
}


def spread_to_slots(
    df: DataFrame, slots: Mapping[str, Sequence[int]], columns: Mapping[str, str], size: int, out: str = "slots"
) -> DataFrame:
    """Copy each group's value into its member slots; other slots are 0."""
    source = {i: columns[group] for group, members in slots.items() for i in members}
    values = [named(source[i]).cast("double") if i in source else F.lit(0.0) for i in range(size)]
    return df.withColumn(out, F.array(*values))
