"""Connected components by alternating large-star and small-star.

An edge table is rewritten until it stays the same. Large-star links every node's larger neighbours to the least node
among it and its neighbours; small-star links a node and its smaller neighbours to the least of them. Both keep the
components, and together they end in one star per component, around its least node. A node's neighbours are never
gathered: its least one comes from an aggregation and meets the edges in a join, so a hub costs rows, not memory.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidelog.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """``u`` > ``v`` of the stars around the least neighbours, from edges ``u`` > ``v``."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    least = both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("to"))
    return both.filter("other > node").join(least, "node").select(F.col("other").alias("u"), F.col("to").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """``u`` > ``v``: every node and its smaller neighbours linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("to"))
    others = edges.join(least, "u").filter("v <> to").select(F.col("v").alias("u"), F.col("to").alias("v"))
    return others.union(least.select("u", "to")).distinct()


def _told(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()[:]


def star_components(edges: DataFrame) -> DataFrame:
    """``member``, ``class`` of every node of the edges (``a``, ``b``): the least node that it can reach.

    Repeated edges, edges in either direction and loops are fine; loops make classes of their own only where the node
    has other edges. Tables of every round stay in files, so a lost executor repeats one round at most.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    told = _told(now)
    while told[0]:
        now = stored(small_star(stored(large_star(now), "stars")), "stars")
        before, told = told, _told(now)
        if told == before:
            break
    return now.select(F.col("u").alias("member"), F.col("v").alias("class")).union(now.select("v", "v")).distinct()
