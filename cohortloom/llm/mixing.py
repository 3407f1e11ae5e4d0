"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in the order of a hash, form one stream of words that is cut into blocks of ``block_words``
words (its last block may be shorter). A mix of all sources is drawn in shards of ``shard_slots`` slots, a block each:

1. ``targets``: weights are dealt to the sources by code point (null last) and scaled to the words of the whole table;
   where a target is above ``most`` times its source's words it stops there and the excess is shared again by weight.
   A source's number of slots is its target over the mean length of its blocks, rounded.
2. ``draws``: each shard draws how many of its slots each source fills. All shards draw from one urn that holds as many
   tickets of a source as it has slots, so a shard's counts are a multinomial draw given the totals of the mix, and the totals hold exactly.
3. ``slots``: the draws of a source are numbered through all shards. Number ``k`` takes block ``k mod blocks`` of round
   ``k div blocks``, mapped through a pseudorandom permutation of the source's block numbers, a new one each round. A
   source therefore gives no block twice before it has given each once, and none more than ``most`` times.
4. Blocks are joined to slots by number.

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012): in each round a number x and its partner
(key - x) mod n change places if a hash bit of the larger one says so, which is a bijection of 0..n-1 for any n.

A stream's order and prefix sums come from two levels of windows, each with about the square root of the number of
rows, so no task orders a whole source. All steps depend on hashes of ids and texts only, so reruns agree.

Nulls: a null text has no words, a null source is a source of its own, a null id stays null. Empty and null texts are
in no block and are taken 0 times. Very long texts spread over many blocks. Rows that are alike in id and text are placed next to each other in
either order, each on its own words. Empty tables give empty results. Other columns of ``docs`` are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import partitions
from cohortloom.runtime import SMALL_TABLE_ROWS, settle

#: What a word is made of; all other signs separate words.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"
SEED = 20_231
ROUNDS = 16
#: Draws that one row unfolds to.
UNFOLDED = 10_000
TARGETS = "place int, source string, rows long, source_size long, weight double, target double, blocks long, slots long, tickets_before long"


def word_count(text: Column) -> Column:
    """Number of words; each word becomes one sign, then the gaps go. No array of words is made."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, GAPS, "")), F.lit(0)).cast("long")


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, place_hash) of every row."""
    identity = F.xxhash64(F.lit(seed), F.col(id).cast("long"), F.col(text).cast("string"))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       word_count(F.col(text).cast("string")).alias("size"), identity.alias("place_hash"))


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = 64) -> DataFrame:
    """A row per source: its ``place``, size, ``target`` and numbers of blocks and slots.

    The shares are found by filling up: with the sources ordered by limit over weight, a source stops at its limit if
    the level that the sources before it leave would lift it above. This table has one row per source, ordered in one task.
    """
    totals = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    placed = (totals.withColumn("place", (F.row_number().over(by_name) - 1).cast("int"))
              .withColumn("weight", F.get(dealt, F.col("place") % len(weights)))
              .withColumn("limit", (F.col("source_size") * most).cast("double")))
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)

    def left(column: str) -> Column:
        return F.sum(column).over(whole) - F.coalesce(F.sum(column).over(before), F.lit(0.0))

    size = F.sum("source_size").over(whole).cast("double")
    room = size - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    stops = placed.withColumn("stops", room * F.col("weight") > F.col("limit") * left("weight")).withColumn("size", size)
    held = F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("stops"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)
    level = stops.withColumn("target", F.when(F.col("stops"), F.col("limit"))
                             .otherwise((F.col("size") - held) / F.when(free > 0, free) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    mean = F.col("source_size") / F.when(F.col("blocks") > 0, F.col("blocks"))
    slots = F.coalesce(F.least(F.round(F.col("target") / mean).cast("long"), F.col("blocks") * most), F.lit(0))
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (level.withColumn("blocks", blocks).withColumn("slots", slots.cast("long"))
            .withColumn("tickets_before", F.coalesce(F.sum("slots").over(earlier), F.lit(0)).cast("long"))
            .select(*[field.split(" ")[0] for field in TARGETS.split(", ")]))


def permuted(x: Column, n: Column, *key: Column, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The image of ``x`` under the pseudorandom permutation of 0..n-1 that belongs to ``key``."""
    def swap_or_not(y: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), *key, r), n) - y, n)
        bit = F.xxhash64(F.lit(seed + 1), *key, r, F.greatest(y, partner)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, partner).otherwise(y)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(rounds)]), x.cast("long"), swap_or_not)


def draws(sources: DataFrame, shard_slots: int, seed: int = SEED) -> DataFrame:
    """(shard, place, blocks, drawn, first): how many slots of a shard a source fills, and the number of the first of them.

    Ticket numbers are permuted over the whole mix; ticket t lies in the shard of its image.
    """
    total = F.sum("slots").over(Window.partitionBy())
    pieces = (sources.select("place", "blocks", "slots", "tickets_before", total.alias("all")).filter("slots > 0")
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / UNFOLDED)))))
    # a fixed number of partitions: few rows unfold to many, so they are not to be put together
    tickets = (pieces.repartition(partitions(sources.sparkSession), "place", "piece")
               .withColumn("k", F.explode(F.sequence(F.col("piece") * UNFOLDED,
                                                     F.least(F.col("slots"), (F.col("piece") + 1) * UNFOLDED) - 1))))
    at = permuted(F.col("tickets_before") + F.col("k"), F.col("all"), F.lit(-1).cast("long"), seed=seed)
    counts = (tickets.withColumn("shard", F.floor(at / shard_slots).cast("long"))
              .groupBy("shard", "place", "blocks").agg(F.count("*").alias("drawn")))
    return _running(counts, "drawn", "first", "place", "shard")


def _running(counts: DataFrame, value: str, name: str, group: str, order: str) -> DataFrame:
    """The sum of ``value`` over earlier rows of the group, through stretches of 1,000 values of ``order``."""
    cut = counts.withColumn("stretch", F.floor(F.col(order) / 1000))
    earlier = Window.partitionBy(group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    lead = (cut.groupBy(group, "stretch").agg(F.sum(value).alias("held"))
            .select(group, "stretch", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("lead")))
    inside = Window.partitionBy(group, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (within.join(lead, [group, "stretch"])
            .withColumn(name, (F.col("lead") + F.col("inside")).cast("long")).drop("stretch", "lead", "inside"))


def slots(sources: DataFrame, shard_slots: int = 8192, seed: int = SEED) -> DataFrame:
    """(shard, slot_hash, place, block): the block that each slot of the mix takes; a shard is read in the order of slot_hash."""
    counted = draws(sources, shard_slots, seed).repartition(partitions(sources.sparkSession), "shard", "place")
    drawn = counted.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))
    numbered = drawn.withColumn("k", F.col("first") + F.col("nth"))
    turn = F.floor(F.col("k") / F.col("blocks")).cast("long")
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("place").cast("long"), turn, seed=seed)
    return numbered.select("shard", F.xxhash64(F.lit(seed), "shard", "place", "k").alias("slot_hash"), "place", block.alias("block"))


def _small(sources: DataFrame) -> DataFrame:
    """The table of sources, to be broadcast if it is counted to be small."""
    return F.broadcast(sources) if sources.count() <= SMALL_TABLE_ROWS else sources


def positions(rows: DataFrame, sources: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Adds ``place`` and ``start``, the number of words of the row's source stream before it."""
    pieces = max(1, int((sources.agg(F.sum("rows")).first()[0] or 1) ** 0.5))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    named = rows.withColumn("source_key", key).join(_small(sources.select(key.alias("source_key"), "place")), "source_key")
    cut = named.withColumn("piece", F.pmod("place_hash", F.lit(pieces)))
    inside = Window.partitionBy("place", "piece").orderBy("place_hash", "doc_id", "size")
    earlier = Window.partitionBy("place").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    lead = (cut.groupBy("place", "piece").agg(F.sum("size").alias("held"))
            .select("place", "piece", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("lead")))
    within = cut.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return (within.join(lead, ["place", "piece"])
            .select("doc_id", "source", "size", "place", (F.col("lead") + F.col("inside")).alias("start"), *carried))


def segments(placed: DataFrame, block_words: int = 64) -> DataFrame:
    """A row per document and block that it has words in: ``block``, ``first_word`` (of the document) and ``words``."""
    end = F.col("start") + F.col("size")
    block = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    cut = placed.filter("size > 0").withColumn("block", F.explode(block))
    low = F.greatest(F.col("block") * block_words, F.col("start"))
    high = F.least((F.col("block") + 1) * block_words, end)
    return cut.withColumn("first_word", low - F.col("start")).withColumn("words", high - low)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
        most: int = 3, block_words: int = 64, shard_slots: int = 8192, seed: int = SEED) -> DataFrame:
    """The mix itself: ``shard``, ``slot_hash`` (order in the shard), ``source``, ``block``, ``words`` and ``text`` (words joined by a space)."""
    rows = settle(sized(docs, id, text, source, seed))
    shares = settle(targets(rows, weights, most, block_words))
    whole = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                        F.col(text).cast("string").alias("body"))
    with_text = whole.select("doc_id", "source", word_count(F.col("body")).alias("size"),
                             F.xxhash64(F.lit(seed), "doc_id", "body").alias("place_hash"), "body")
    cut = segments(positions(with_text, shares, ["body"]), block_words)
    part = F.slice(F.regexp_extract_all("body", F.lit(f"({WORD})"), F.lit(1)), (F.col("first_word") + 1).cast("int"), F.col("words").cast("int"))
    pieces = cut.select("place", "source", "block", "start", "words", F.concat_ws(" ", part).alias("piece"))
    blocks = pieces.groupBy("place", "source", "block").agg(
        F.sum("words").alias("words"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"])).alias("text"))
    return (slots(shares, shard_slots, seed).hint("merge").join(blocks, ["place", "block"])
            .select("shard", "slot_hash", "source", "block", "words", "text"))


def taken(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
          most: int = 3, block_words: int = 64, shard_slots: int = 8192, seed: int = SEED) -> DataFrame:
    """One row per document row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken``, the words of it in the mix."""
    rows = settle(sized(docs, id, text, source, seed))
    shares = settle(targets(rows, weights, most, block_words))
    placed = settle(positions(rows, shares))
    uses = slots(shares, shard_slots, seed).groupBy("place", "block").agg(F.count("*").alias("uses"))
    # as many uses as blocks; the planner takes them for few, as they unfold from the table of sources
    found = (segments(placed, block_words).join(uses.hint("merge"), ["place", "block"], "left")
             .groupBy("place", "doc_id", "size", "start")
             .agg(F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken")))
    empty = placed.filter("size = 0").select("place", "doc_id", "size", "start", F.lit(0).cast("long").alias("taken"))
    every = found.unionByName(empty)
    return every.join(_small(shares.select("place", "source", "source_size", "target")), "place").select("doc_id", "source", "size", "source_size", "target", "taken")
