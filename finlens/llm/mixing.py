"""Mixing sources to target weights, in DataFrame operations only.

1. Every document's words are counted; a source's documents follow each other
   in a fixed pseudorandom order as one stream of words, cut into blocks of
   ``block_words`` words, whatever the size of corpus and source (a source's
   last block holds what is left).
2. Targets: the sources' weights share all words; a target stops at ``cap``
   times its source's size and the excess is shared again by weight.
3. The slots of all shards are the places of a pseudorandom permutation of
   the targets' slots, read by inverse distribution: each shard's source counts
   are a multinomial draw given the totals, which are the targets to a slot.
   The draws are keyed by the seed, so reruns agree.
4. A source's slots are numbered over all shards.  Slot ``k`` maps to epoch
   ``k div blocks`` and to the block a pseudorandom permutation of the
   source's indexes (swap-or-not, keyed by source and epoch) gives to ``k mod
   blocks``.  Slots beyond ``cap`` epochs fall away, so no block, and no
   document, is taken more than ``cap`` times.
5. Blocks join slots by (source, block index).

Scale: running positions come from two levels of sums (per chunk, then inside
a chunk), so a hot source is spread over many tasks; the inverse distribution
is an equi-join on cells of the unit interval; only per-source rows (one per
label) meet in a window without partitions.

Defined results: null text has size 0 and is taken 0 times, as any text
without words; a null source is a source of its own, last in order; repeated
rows are separate documents; an empty table gives an empty result.  Extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlens.llm.store import partitions, pick, save, spare_name

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 32
SHARD_SLOTS = 32
CELLS = 4096
ROUNDS = 12
CHUNK_ROWS = 20_000
_BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Mix:
    """``documents``: one row per document with its place in its source's
    stream.  ``sources``: sizes, targets, block lengths.  ``slots``: (shard,
    source, block) of the output, one row per slot."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source (source, source_size): weight and target.

    Filling sources in the order of cap / weight, a source is at its cap
    while that is below the level the words left and weights left give; the
    level peaks at the first source below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    rows = rows.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(*_BEFORE)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left)
    return rows.withColumn("target", F.least(F.max("level").over(whole) * F.col("weight"), F.col("limit"))).drop(
        "level", "limit")


def running_start(rows: DataFrame, value: str, chunk: Column, order: Sequence[str | Column], out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the earlier rows of the same source, in
    (chunk, order): per-chunk sums first, then inside each chunk."""
    rows = rows.withColumn("_chunk", chunk)
    sums = rows.groupBy("source", "_chunk").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy("source").orderBy("_chunk").rowsBetween(*_BEFORE)
    base = sums.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"),
                       F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_chunk").orderBy(*order).rowsBetween(*_BEFORE)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.join(base, rows["source"].eqNullSafe(base["_s"]) & (rows["_chunk"] == base["_c"]))
    return rows.withColumn(out, F.col("_base") + F.col("_in")).drop("_chunk", "_s", "_c", "_base", "_in")


def permuted(k: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1 applied to ``k`` (swap-or-not)."""

    def swap(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        swaps = F.xxhash64(r, *key, F.greatest(x, partner), F.lit(1)).bitwiseAND(F.lit(1)) == 1
        return F.when(swaps, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k, swap)


def with_permuted(df: DataFrame, out: str, k: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with ``out`` = ``permuted(k, n, *key)``.  Each round is a
    projection of its own, compiled with the stage, where the one expression
    of ``permuted`` is interpreted row by row."""
    size, partner = spare_name(df, "_n"), spare_name(df, "_partner")
    df = df.withColumns({size: F.greatest(n, F.lit(1)), out: k})  # an empty range has no row to place
    x, n = F.col(out), F.col(size)
    for r in range(1, rounds + 1):
        df = df.withColumn(partner, F.pmod(F.pmod(F.xxhash64(F.lit(r), *key), n) - x, n))
        swaps = F.xxhash64(F.lit(r), *key, F.greatest(x, F.col(partner)), F.lit(1)).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(out, F.when(swaps, F.col(partner)).otherwise(x))
    return df.drop(size, partner)


def draw_slots(sources: DataFrame, n_slots: int, seed: int, cap: int) -> DataFrame:
    """(shard, source, block): the output's slots, drawn shard by shard."""
    spark = sources.sparkSession
    share = F.col("n_slots") / F.sum("n_slots").over(Window.partitionBy())
    named = Window.orderBy("place")
    odds = sources.withColumn("lo", F.coalesce(F.sum(share).over(named.rowsBetween(*_BEFORE)), F.lit(0.0)))
    odds = odds.withColumn("hi", F.coalesce(F.lead("lo").over(named), F.lit(1.0)))
    odds = odds.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    slot = spark.range(n_slots).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), "id")
    slot = with_permuted(slot, "place", F.col("id"), F.lit(n_slots).cast("bigint"), F.lit(seed), F.lit("slots"))
    # written, as a condition of the join below would be pushed through all rounds
    slot = save(slot, "slots")
    u = (F.col("place") + 0.5) / F.lit(float(n_slots))
    slot = slot.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = slot.join(odds.select("cell", "lo", "hi", "source"), "cell").where("u >= lo and u < hi")
    # written once: the running sums below read the counts twice
    counts = save(drawn.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n")), "slot-counts")
    counts = running_start(counts, "n", F.floor(F.col("shard") / 4096), ["shard"], "first")
    about = sources.select(F.col("source").alias("_s"), "n_blocks")
    counts = counts.join(about, counts["source"].eqNullSafe(about["_s"])).drop("_s")
    # few rows that become many: not left to one task
    counts = counts.repartition(partitions(spark), "shard")
    k = counts.select("shard", "source", "n_blocks", F.explode(F.sequence(
        F.col("first"), F.col("first") + F.col("n") - 1)).alias("k")).where(F.col("k") < F.col("n_blocks") * cap)
    epoch = F.floor(F.col("k") / F.col("n_blocks"))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    k = k.withColumns({"name": name, "epoch": epoch})
    k = with_permuted(k, "block", F.pmod(F.col("k"), F.col("n_blocks")), F.col("n_blocks"), F.lit(seed), F.col("name"), F.col("epoch"))
    return save(k.select("shard", "source", "block"), "slot-blocks")


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 20,
             block_words: int = BLOCK_WORDS) -> Mix:
    """Targets, document places and drawn slots of a mix."""
    rows = pick(df, id=id_col, t=text_col, source=source_col)
    size = F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = save(rows.select("id", F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    totals = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sources.withColumn("block_words", F.lit(block_words).cast("bigint")).withColumn(
        "n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("bigint"))
    # a slot of the source holds source_size / n_blocks words in the mean
    sources = sources.withColumn("n_slots", F.when(
        F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    sources = save(sources, "mix-sources")
    wanted = sources.agg(F.sum("n_slots")).first()[0]
    slots = draw_slots(sources, int(-(-(wanted or 0) // 1)), seed, cap)
    chunks = max(1, totals["rows"] // CHUNK_ROWS)
    placed = running_start(sized, "size", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(chunks)), ["id", "size"], "start")
    return Mix(placed, sources, slots)


def pieces(mix: Mix) -> DataFrame:
    """One row per (document, block it reaches into): the words they share,
    as ``from_word`` and ``n_words`` of the document."""
    about = mix.sources.select(F.col("source").alias("_s"), "source_size", "target", "block_words")
    docs = mix.documents.join(about, mix.documents["source"].eqNullSafe(about["_s"])).drop("_s")
    reach = docs.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("block_words")),
        F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")))))
    first = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    return reach.withColumn("from_word", first - F.col("start")).withColumn("n_words", last - first)


def mixed(mix: Mix) -> DataFrame:
    """The mix itself: per shard and slot, the document pieces its block holds
    (shard, source, block, id, from_word, n_words)."""
    return _joined(pieces(mix), mix.slots).select("shard", "source", "block", "id", "from_word", "n_words")


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({"source": "_s", "block": "_b"})
    return left.join(right, left["source"].eqNullSafe(right["_s"]) & (left["block"] == right["_b"]), how).drop("_s", "_b")


def taken(mix: Mix) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken."""
    times = mix.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    keys = ["id", "source", "size", "source_size", "target"]
    part = _joined(pieces(mix), times, "left")
    some = part.groupBy(*keys, "start").agg(
        F.sum(F.col("n_words") * F.coalesce(F.col("times"), F.lit(0))).cast("bigint").alias("taken")).drop("start")
    about = mix.sources.select(F.col("source").alias("_s"), "source_size", "target")
    empty = mix.documents.where("size = 0")
    none = empty.join(about, empty["source"].eqNullSafe(about["_s"])).select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none)
