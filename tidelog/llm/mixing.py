"""Mixing sources to target weights by Pfair scheduling.

The rows of each source form blocks. With weight w, block k (from 0) of a source is released at slot floor(k / w)
and due by slot ceil((k + 1) / w); earliest deadline first fills the slots, so that at any slot the blocks a source
has got differ from slot * w by less than one. Weights are integers over their sum (target weights in steps of 2^-32),
and releases and deadlines are exact: nothing is rounded to a period. A source that has run out leaves its slots empty;
the other sources keep their slots and so their proportions. The schedule is a fold over the blocks; all work is
DataFrame expressions.

A block holds BLOCK_ROWS rows, or so many more (a power of two) that MAX_BLOCKS blocks hold all rows: the schedule is a
sequence by its nature and stays of bounded length, whatever the input. Its work is blocks times sources.

Defined results: no row is dropped or repeated. A null source is a source of its own. Within a source, rows come in
pseudo-random order of their id; rows with equal or null ids in that of their place in the files. An empty table gives an
empty table. Columns ``slot``, ``block``, ``place`` and ``position`` of the input are replaced, others pass through
whatever they are called. Weights must be positive and be given for every source.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidelog.llm.common import fresh, placed, stored
from tidelog.llm.spans import let

#: Least rows in a block, most blocks, rows that are numbered in one task, about.
BLOCK_ROWS, MAX_BLOCKS, CHUNK_ROWS = 64, 1 << 20, 20_000
#: Default target: shares in proportion to the size of a source to this power.
TEMPERATURE = 0.5
#: Steps of the weights; blocks that one fold schedules before its list is put away.
STEPS, FOLD = 1 << 32, 1000
RESULTS = ("block", "slot", "place", "position")


def target_weights(counts: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``source``, ``n`` and the integer weight ``w`` of a table of ``source``, ``n``.

    ``weights`` maps sources to relative weights; by default the sizes to the power TEMPERATURE.
    """
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        if not all(v > 0 for v in weights.values()):
            raise ValueError("weights must be positive")
        given = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        w = F.coalesce(*given, F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null")))).cast("double"))
    total = F.sum("v").over(Window.partitionBy(F.lit(0)))  # one row per source
    return counts.withColumn("v", w).select("source", "n", F.greatest(F.round(F.col("v") / total * STEPS), F.lit(1)).cast("bigint").alias("w"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def schedule(weights: DataFrame, block_rows: int) -> DataFrame:
    """``source``, ``block`` and ``slot`` of every block of the sources ``source``, ``n`` (rows), ``w``, by EDF.

    The fold carries the last slot and how many blocks each source has got. A slot goes to the released block with
    the earliest deadline, ties to the earlier source; slots that no block is released for are left out.
    """
    blocks = _div(F.col("n") + F.lit(block_rows - 1), F.lit(block_rows).cast("bigint"))
    one = weights.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("s"), "source", F.col("w"), blocks.alias("blocks")))).alias("q"), F.sum("w").alias("all"), F.sum(blocks).alias("blocks"))
    one = one.filter("blocks > 0")
    every = F.col("all")
    item = "array<struct<i:int,k:bigint,slot:bigint>>"

    def step(state: Column) -> Column:
        both = F.arrays_zip(F.col("q").alias("q"), state["got"].alias("got"))
        release = F.transform(both, lambda x: F.when(x["got"] < x["q"]["blocks"], _div(x["got"] * every, x["q"]["w"])))

        def at_slot(slot: Column, released: Column) -> Column:
            due = F.transform(both, lambda x, i: F.when(released[i] <= slot, F.struct(_div((x["got"] + 1) * every + x["q"]["w"] - 1, x["q"]["w"]).alias("due"), i.alias("i"))))
            return let(F.array_min(due)["i"], lambda best: F.struct(
                slot.alias("slot"), F.transform(state["got"], lambda g, i: F.when(i == best, g + 1).otherwise(g)).alias("got"),
                F.concat(state["part"], F.array(F.struct(best.alias("i"), state["got"][best].alias("k"), slot.alias("slot")))).alias("part")))

        return let(release, lambda r: let(F.greatest(state["slot"] + 1, F.array_min(r)), lambda slot: at_slot(slot, r)))

    def fold(state: Column, chunk: Column) -> Column:
        steps = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(FOLD), F.col("blocks") - chunk * FOLD))
        kind = f"struct<slot:bigint,got:array<bigint>,part:{item}>"
        first = F.struct(state["slot"].alias("slot"), state["got"].alias("got"), F.array().cast(item).alias("part")).cast(kind)
        return let(F.aggregate(steps, first, lambda s, _: step(s).cast(kind)), lambda s: F.struct(
            s["slot"].alias("slot"), s["got"].alias("got"), F.concat(state["parts"], F.array(s["part"])).alias("parts")))

    kind = f"struct<slot:bigint,got:array<bigint>,parts:array<{item}>>"
    first = F.struct(F.lit(-1).cast("bigint").alias("slot"), F.transform("q", lambda x: F.lit(0).cast("bigint")).alias("got"), F.array().cast(f"array<{item}>").alias("parts")).cast(kind)
    chunks = F.sequence(F.lit(0).cast("bigint"), _div(F.col("blocks") - 1, F.lit(FOLD).cast("bigint")))
    order = F.aggregate(chunks, first, lambda s, c: fold(s, c).cast(kind), lambda s: s["parts"])
    placed_blocks = one.select(F.transform("q", lambda x: x["source"]).alias("names"), F.explode(order).alias("part")).select("names", F.explode("part").alias("o"))
    return placed_blocks.select(F.col("names")[F.col("o.i")].alias("source"), F.col("o.k").alias("block"), F.col("o.slot").alias("slot"))


def numbered_within(rows: DataFrame, chunks: int) -> DataFrame:
    """Add ``k``, the number of a row within its source ``s`` (from 0) by the hash of its ``id``, then ``id`` and ``at``.

    Chunks of the hash are numbered apart, so a hot source is split; only one count per source and chunk is summed
    along the chunks.
    """
    rows = rows.withColumn("h", F.xxhash64("id", "at")).withColumn("chunk", F.pmod(F.col("h"), F.lit(chunks)))
    counts = rows.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = counts.select(F.col("s").alias("_s"), F.col("chunk").alias("_c"), (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("h", "id", "at"))
    out = rows.withColumn("i", inside).join(before, F.col("s").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
    return out.select("row", "s", (F.col("before") + F.col("i") - 1).alias("k"))


def mixed_order(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None,
                block_rows: int | None = None, row: str | None = None) -> DataFrame:
    """Add to every row ``block`` (within its source), ``slot`` (of the block), ``place`` (in the block) and
    ``position`` (``slot`` times the rows of a block plus ``place``, the key to sort by for the mixed order).

    ``row`` names a column of distinct row numbers; without it rows are numbered by their place.
    """
    at = row or fresh(docs, "_at")
    rows = docs if row else placed(docs, at)
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = rows.select(F.struct(*keep).alias("row"), F.col(key).alias("id"), F.col(source).alias("s"), F.col(at).alias("at"))
    counts = stored(rows.groupBy(F.col("s").alias("source")).agg(F.count("*").alias("n")), "mix-counts", "snappy")
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = block_rows or BLOCK_ROWS
    while not block_rows and size * MAX_BLOCKS < total:
        size *= 2
    plan = stored(schedule(target_weights(counts, weights), size), "mix-schedule", "snappy")
    found = numbered_within(rows, max(1, total // CHUNK_ROWS)).withColumn("block", F.floor(F.col("k") / size)).withColumn("place", F.col("k") % size)
    found = found.join(plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "slot"), F.col("s").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    return found.select("row.*", "block", "slot", "place", (F.col("slot") * size + F.col("place")).alias("position"))
