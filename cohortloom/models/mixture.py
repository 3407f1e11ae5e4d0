"""Two-component mixtures of scores and the scaling by their lower part.

The mixtures of all scores and groups are fitted together: the state is a small table with one row for each (group,
score), a step is one grouped aggregate over the cached values, in generated JVM code, and rows of finished mixtures
drop out. The start is a deterministic two-means split, so a result does not depend on how the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortloom.functions.rowwise import double_of, nan_to_null, named
from cohortloom.models.common import cached
from cohortloom.runtime import bounded_rows, join_small

# Added to every variance (fixed value).
VARIANCE_FLOOR = 1e-6
# (group, score) pairs of one fit; their state is on the driver.
MAX_MIXTURES = 100_000

Parts = list[tuple[float, float, float]]


def _parts(moments: Sequence[float]) -> Parts:
    """[(mean, variance, weight)] from the count and the sums of both parts."""
    n, out = moments[0], []
    for size, first, second in (moments[1:4], moments[4:7]):
        size += 1e-12
        mean = first / size
        out.append((mean, max(second / size - mean * mean, 0.0) + VARIANCE_FLOOR, size / n))
    return out


def _step(x: DataFrame, state: Mapping[int, Sequence[float]], fields: Sequence[str], *aggregates) -> dict[int, list]:
    """The aggregates of every mixture in ``state`` over its values; the others' rows drop out."""
    rows = [(key, *map(float, values)) for key, values in state.items()]
    schema = "key int, " + ", ".join(f"{f} double" for f in fields)
    # bounded by MAX_MIXTURES
    fed = x.join(F.broadcast(x.sparkSession.createDataFrame(rows, schema)), "key")
    return {r[0]: list(r)[1:] for r in fed.groupBy("key").agg(*[F.expr(a) for a in aggregates]).collect()}


def _cuts(x: DataFrame, ends: dict[int, tuple[float, float]], spread: Mapping[int, float]) -> dict[int, float]:
    """Per mixture the cut between two one-dimensional means, from the extremes inwards."""
    open_ = dict(ends)
    for _ in range(100):
        if not open_:
            break
        means = _step(x, {k: ((low + high) / 2.0,) for k, (low, high) in open_.items()}, ["cut"],
                      "avg(CASE WHEN x <= cut THEN x END)", "avg(CASE WHEN x > cut THEN x END)")
        for key, (below, above) in means.items():
            low, high = open_[key]
            below, above = (low if below is None else below), (high if above is None else above)
            ends[key] = open_[key] = below, above
            if (below - low) ** 2 + (above - high) ** 2 <= 1e-4 * spread[key]:
                del open_[key]
    return {k: (low + high) / 2.0 for k, (low, high) in ends.items()}


_SUMS = ("CAST(count(*) AS DOUBLE)", "sum({a})", "sum({a} * x)", "sum({a} * x * x)",
         "sum(1D - {a})", "sum((1D - {a}) * x)", "sum((1D - {a}) * x * x)")
_LOGS = ("(c1 - (x - m1) * (x - m1) * h1)", "(c2 - (x - m2) * (x - m2) * h2)")
_TOP = f"greatest({_LOGS[0]}, {_LOGS[1]})"
_LEVEL = f"avg({_TOP} + ln(exp({_LOGS[0]} - {_TOP}) + exp({_LOGS[1]} - {_TOP})))"
_SHARE = f"(1D / (1D + exp({_LOGS[1]} - {_LOGS[0]})))"


def _state(parts: Parts) -> list[float]:
    out = []
    for mean, variance, weight in parts:
        out += [math.log(max(weight, 1e-300)) - 0.5 * math.log(2 * math.pi * variance), mean, 0.5 / variance]
    return out


def _keyed_values(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    block = F.expr("array(" + ", ".join(double_of(n) for n in names) + ")")
    groups = [named(b).alias(f"g{i}") for i, b in enumerate(by)]
    return df.select(*groups, F.posexplode(block).alias("pos", "v")).filter("v IS NOT NULL AND NOT isnan(v)")


def fit_mixtures(
    df: DataFrame, names: Sequence[str], by: Sequence[str] = (), max_iter: int = 100, tol: float = 1e-3
) -> DataFrame:
    """(by..., score, part, mean, std, weight): two parts, by rising mean, for each group and score column.

    A mixture stops when its mean log likelihood moves by less than ``tol``. Null and NaN values are left out; a group
    (null is one) with fewer than two values of a score has no rows. More than ``MAX_MIXTURES`` pairs are refused.
    """
    groups = [f"g{i}" for i in range(len(by))]
    long = _keyed_values(df, names, by)
    stats = bounded_rows(
        long.groupBy(*groups, "pos")
        .agg(F.count("v").alias("n"), F.avg("v").alias("center"), F.min("v").alias("low"), F.max("v").alias("high"),
             F.var_pop("v").alias("spread"))
        .filter("n >= 2"),
        MAX_MIXTURES, "mixtures",
    )
    spark, fields = df.sparkSession, {f.name: f for f in df.schema.fields}
    kinds = [StructField(g, fields[b].dataType) for g, b in zip(groups, by)]
    keys = {i: tuple(r[g] for g in groups) for i, r in enumerate(stats)}
    fitted: dict[int, Parts] = {}
    if stats:
        head = StructType(list(kinds)).add("pos", "integer").add("key", "integer").add("center", "double")
        small = spark.createDataFrame([(*keys[i], r["pos"], i, r["center"]) for i, r in enumerate(stats)], head)
        small = small.withColumnsRenamed({g: f"_{g}" for g in groups}).withColumnRenamed("pos", "_pos")
        on = F.col("pos") == F.col("_pos")
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
        # centred, so that squares do not cancel
        x = cached(long.join(F.broadcast(small), on).selectExpr("key", "v - center AS x"))
        try:
            ends = {i: (r["low"] - r["center"], r["high"] - r["center"]) for i, r in enumerate(stats)}
            cuts = _cuts(x, ends, {i: r["spread"] for i, r in enumerate(stats)})
            first = "CASE WHEN x <= cut THEN 1D ELSE 0D END"
            sums = _step(x, {k: (c,) for k, c in cuts.items()}, ["cut"], *[s.format(a=first) for s in _SUMS])
            fitted = {k: _parts(v) for k, v in sums.items()}
            before = dict.fromkeys(fitted, -math.inf)
            for _ in range(max_iter):
                if not before:
                    break
                sums = _step(x, {k: _state(fitted[k]) for k in before}, ["c1", "m1", "h1", "c2", "m2", "h2"],
                             _LEVEL, *[s.format(a=_SHARE) for s in _SUMS])
                for key, (level, *moments) in sums.items():
                    fitted[key] = _parts(moments)
                    if abs(level - before[key]) < tol:
                        del before[key]
                    else:
                        before[key] = level
        finally:
            x.unpersist()
    rows = []
    for key, parts in fitted.items():
        center = stats[key]["center"]
        for part, values in enumerate(sorted((m + center, math.sqrt(v), w) for m, v, w in parts)):
            rows.append((*keys[key], names[stats[key]["pos"]], part, *values))
    out = StructType(list(kinds)).add("score", "string").add("part", "integer")
    for f in ("mean", "std", "weight"):
        out = out.add(f, "double")
    made = spark.createDataFrame(rows, out)
    return made.toDF(*by, "score", "part", "mean", "std", "weight")


def two_components(df: DataFrame, name: str, max_iter: int = 100, tol: float = 1e-3) -> Parts:
    """[(mean, std, weight)] by rising mean, or [] below two values."""
    rows = fit_mixtures(df, [name], (), max_iter, tol).collect()
    return [(r["mean"], r["std"], r["weight"]) for r in sorted(rows, key=lambda r: r["part"])]


def mixture_scores(df: DataFrame, names: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``(x - mean) / std`` of the lower component for each {score: new column}, one fit for all.

    With ``by`` each group has its own mixtures, and a group with fewer than two values gets null; without, a score
    with fewer than two values adds no column.
    """
    found = fit_mixtures(df, list(names), by).filter("part = 0")
    value = lambda n: nan_to_null(named(n).cast("double"))
    if not by:
        lower = {r["score"]: r for r in found.collect()}
        return df.withColumns({
            out: (value(n) - F.lit(lower[n]["mean"])) / F.lit(lower[n]["std"]) for n, out in names.items() if n in lower
        })
    keys = {b: f"_by{i}" for i, b in enumerate(by)}
    cell = F.struct("mean", "std")
    small = found.groupBy(*[named(b).alias(k) for b, k in keys.items()]).agg(
        *[F.max(F.when(F.col("score") == n, cell)).alias(f"_lower{i}") for i, n in enumerate(names)]
    )
    on = F.lit(True)
    for b, k in keys.items():
        on = on & named(b).eqNullSafe(F.col(k))
    joined = join_small(df, small, on, "left", limit=MAX_MIXTURES)
    added = {
        out: (value(n) - F.col(f"_lower{i}.mean")) / F.col(f"_lower{i}.std") for i, (n, out) in enumerate(names.items())
    }
    return joined.withColumns(added).drop(*keys.values(), *[f"_lower{i}" for i in range(len(names))])


def mixture_score(df: DataFrame, name: str, out: str) -> DataFrame:
    """``mixture_scores`` of one column."""
    return mixture_scores(df, {name: out})
