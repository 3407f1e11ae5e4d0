"""Ranking and quantiles that never put one whole group into one task.

A class may hold a third of all rows, so ``row_number() over (partition by
class)`` on the raw rows is ruled out. Ranks are built from counts of finer
pieces (hash prefixes or sorted partitions) plus a short window inside each
piece; quantiles from a bounded sketch that brackets the wanted rank, and an
exact count of the few values inside the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, nan_to_null
from cohortloom.runtime import join_small, settle, small_local

# Rows a single window task may rank; larger groups are cut into pieces.
PIECE_ROWS = 500_000


def seeded_key(ids: Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random text key of a row id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[named(i).cast("string") for i in ids]))


def _group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(group, _size, _digits): rows, and how many key digits make a piece.

    A group of up to ``PIECE_ROWS`` rows is one piece (no digits); each digit
    splits sixteenfold, so a piece stays small whatever the group's size.
    """
    digits = F.ceil(F.log(16.0, F.col("_size") / F.lit(float(PIECE_ROWS))))
    return (
        df.filter(named(group).isNotNull())
        .groupBy(named(group))
        .agg(F.count("*").alias("_size"))
        .withColumn("_digits", F.greatest(digits, F.lit(0)).cast("int"))
    )


def _cut_up(df: DataFrame, group: str, ids: Sequence[str], seed: int, sizes: DataFrame) -> DataFrame:
    """Rows with their key, their group's size columns and their piece."""
    keyed = df.filter(named(group).isNotNull()).withColumn("_key", seeded_key(ids, seed))
    return join_small(keyed, sizes, [group]).withColumn("_piece", F.expr("substring(_key, 1, _digits)"))


def _piece_offsets(cut: DataFrame, group: str) -> DataFrame:
    """(group, _piece, _before): rows of the group in earlier pieces.

    Only groups in several pieces are counted; the window runs over counts.
    """
    counts = cut.filter("_digits > 0").groupBy(named(group), "_piece").agg(F.count("*").alias("_n"))
    before = W.partitionBy(named(group)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(named(group), "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def _known(sizes: DataFrame) -> tuple[DataFrame, bool]:
    """Group sizes, on the driver when few, and whether any group is cut."""
    local = small_local(sizes)
    sizes = local if local is not None else sizes
    return sizes, bool(sizes.filter("_digits > 0").limit(1).collect())


def hash_rank(df: DataFrame, group: str, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``_rank`` (1-based, by hash key inside the group) and ``_size``.

    The join and the window share the (group, piece) partitioning, so large
    inputs are shuffled once. Rows without a group are dropped.
    """
    sizes, several = _known(_group_sizes(df, group))
    cut = _cut_up(df, group, ids, seed, sizes)
    inside = W.partitionBy(named(group), "_piece").orderBy("_key", *[named(i) for i in ids])
    rank = F.row_number().over(inside)
    if several:
        cut = cut.join(_piece_offsets(cut, group), [group, "_piece"], "left")
        rank = F.coalesce(F.col("_before"), F.lit(0)) + rank
    return cut.withColumn("_rank", rank).select(*[named(c) for c in df.columns], "_rank", "_size")


def hash_cut(df: DataFrame, group: str, ids: Sequence[str], limit: Column, seed: int = 42) -> DataFrame:
    """Keep the first ``limit`` rows of each group by hash key.

    Groups within their limit stay whole and are not ranked. For others the
    piece that reaches the limit is found from counts; rows of later pieces
    are dropped before any shuffle, and only the last kept piece is ranked.
    """
    sizes = _group_sizes(df, group).withColumn("_limit", limit.cast("long"))
    sizes, several = _known(sizes)
    if several:
        offsets = _piece_offsets(_cut_up(df, group, ids, seed, sizes), group)
        reached = join_small(offsets, sizes.select(named(group), "_limit"), [group]).filter("_before < _limit")
        last = reached.groupBy(named(group)).agg(F.max("_piece").alias("_last"), F.max("_before").alias("_before"))
        sizes = sizes.join(last, [group], "left")
    else:
        sizes = sizes.withColumns({"_last": F.lit(None).cast("string"), "_before": F.lit(0).cast("long")})
    cuts = sizes.na.fill({"_last": "", "_before": 0})
    inside = W.partitionBy(named(group), "_piece").orderBy("_key", *[named(i) for i in ids])
    cut = _cut_up(df, group, ids, seed, cuts)
    unranked = cut.filter("_size <= _limit OR _piece < _last")
    ranked = (
        cut.filter("_size > _limit AND _piece = _last")
        .withColumn("_rn", F.row_number().over(inside))
        .filter("_before + _rn <= _limit")
        .drop("_rn")
    )
    return unranked.unionByName(ranked).select(*[named(c) for c in df.columns])


def sorted_position(
    df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """1-based place of every row in a total order, per ``within`` group.

    Rows are range-partitioned by group and order, sorted and written once to
    the checkpoint folder; places then follow from per-partition counts, one
    row per (group, partition). ``order`` must be total (end with an id).
    """
    keys = [named(w).asc_nulls_last() for w in within] + list(order)
    laid = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    # the upper bits of the generated id are the sorted partition's number
    laid = laid.withColumn("_part", F.shiftright("_slot", 33))
    groups = [named(w) for w in within]
    firsts = laid.groupBy(*groups, "_part").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
    window = W.orderBy("_part") if not within else W.partitionBy(*groups).orderBy("_part")
    # this window runs over counts, not over rows
    firsts = firsts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    renamed = firsts.select(
        *[named(w).alias(f"_g{i}") for i, w in enumerate(within)], F.col("_part").alias("_p"), "_first", "_before"
    )
    match = F.col("_part") == F.col("_p")
    for i, w in enumerate(within):
        match = match & named(w).eqNullSafe(F.col(f"_g{i}"))
    return (
        join_small(laid, renamed, match)
        .withColumn(out, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .select(*[named(c) for c in df.columns], out)
    )


# Places of the grid that the sketch of an interval is read at.
GRID = 1000


def _narrowed(clean: DataFrame, spans: DataFrame, group: Sequence[str], accuracy: int) -> DataFrame:
    """Intervals that hold at most ``4 * accuracy`` rows, or few distinct values."""
    keys, before = [named(g) for g in group], None
    fixed = ["q", "lo", "hi", "r0", "r1", "part"]
    while True:
        inside = F.when(F.col("_v").between(F.col("s.lo"), F.col("s.hi")), F.col("_v"))
        seen = settle(
            join_small(clean, spans, list(group))
            .select(*keys, "_v", "n", F.explode("_spans").alias("s"))
            .groupBy(*keys, "n", "s")
            .agg(
                F.count_if(F.col("_v") < F.col("s.lo")).alias("_below"),
                F.count(inside).alias("_c"),
                F.percentile_approx(inside, [i / GRID for i in range(GRID + 1)], accuracy).alias("_g"),
            )
        )
        largest = seen.agg(F.max(F.when(F.col("s.lo") < F.col("s.hi"), F.col("_c")))).first()[0] or 0
        if largest <= 4 * accuracy or (before is not None and largest > before / 2):
            return spans
        before = largest
        # the sketch is off by 1/accuracy, and places lie between grid steps
        steps = 2 + -(-2 * GRID // accuracy)
        low = F.greatest(F.floor((F.col("s.r0") - F.col("_below")) / F.col("_c") * GRID) - steps, F.lit(0)).cast("int")
        high = F.least(F.ceil((F.col("s.r1") - F.col("_below") + 1) / F.col("_c") * GRID) + steps, F.lit(GRID)).cast("int")
        wide = F.col("_c") > 4 * accuracy
        lo = F.when(wide, F.get("_g", low)).otherwise(F.col("s.lo")).alias("lo")
        hi = F.when(wide, F.get("_g", high)).otherwise(F.col("s.hi")).alias("hi")
        ends = {"lo": lo, "hi": hi}
        span = F.struct(*[ends.get(c, F.col(f"s.{c}").alias(c)) for c in fixed])
        spans = settle(seen.groupBy(*keys, "n").agg(F.collect_list(span).alias("_spans")))


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per prob.

    Output: group columns, ``n`` and ``q0, q1, ...``. Missing values and rows
    with a missing group are left out. A bounded sketch gives an interval sure
    to hold each wanted rank; as long as an interval holds more than
    ``4 * accuracy`` rows, a sketch of the rows inside narrows it further.
    Then equal values inside it are counted (map side first) and the rank is
    read off the running count.
    """
    clean = df.select(*[named(g) for g in group], nan_to_null(named(value).cast("double")).alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    for g in group:
        clean = clean.filter(named(g).isNotNull())
    # sketch ranks are within n/accuracy of the asked rank
    slack = 2.0 / accuracy
    asked = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    sketch = clean.groupBy(*[named(g) for g in group]).agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", asked, accuracy).alias("_s"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    spans = []
    for i, p in enumerate(probs):
        rank = (F.col("n") - 1) * F.lit(float(p))
        # short groups are taken whole: the sketch interval may miss by one row
        whole = F.col("n") <= accuracy
        spans.append(
            F.struct(
                F.lit(i).alias("q"),
                F.when(whole, F.col("_min")).otherwise(F.get("_s", F.lit(2 * i))).alias("lo"),
                F.when(whole, F.col("_max")).otherwise(F.get("_s", F.lit(2 * i + 1))).alias("hi"),
                F.floor(rank).alias("r0"),
                F.ceil(rank).alias("r1"),
                (rank - F.floor(rank)).alias("part"),
            )
        )
    spans_df = sketch.select(*[named(g) for g in group], "n", F.array(*spans).alias("_spans"))
    most = spans_df.agg(F.max("n")).first()[0] or 0
    if most * 4 > accuracy * 4 * accuracy:
        spans_df = _narrowed(clean, settle(spans_df), group, accuracy)
    tagged = (
        join_small(clean, spans_df, list(group))
        .select(*[named(g) for g in group], "_v", "n", F.explode("_spans").alias("s"))
        .filter(F.col("_v") <= F.col("s.hi"))
        # everything below the interval collapses into one counted row
        .withColumn("_w", F.when(F.col("_v") >= F.col("s.lo"), F.col("_v")))
    )
    keys = [named(g) for g in group]
    counted = tagged.groupBy(*keys, "n", "s.q", "s.r0", "s.r1", "s.part", "_w").agg(F.count("*").alias("_c"))
    running = W.partitionBy(*keys, "q").orderBy(F.col("_w").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_cum", F.sum("_c").over(running)).filter(F.col("_w").isNotNull())
    read = placed.groupBy(*keys, "n", "q", "part").agg(
        F.min(F.when(F.col("_cum") > F.col("r0"), F.col("_w"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.col("r1"), F.col("_w"))).alias("_b"),
        (F.min(F.col("_cum") - F.col("_c")) <= F.max("r0")).alias("_held"),
    )
    # never a wrong value: a rank outside its interval stops the job
    value_at = F.when(
        F.col("_held") & F.col("_b").isNotNull(), F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("part")
    ).otherwise(F.raise_error(F.lit("quantile rank outside its sketch interval")).cast("double"))
    return read.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("q") == i, value_at)).alias(f"q{i}") for i in range(len(probs))]
    )
