"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are cut into blocks. In a block, every dimension has a list of its rows sorted by their component; blocks and
lists are built and written once. A query walks the lists in step, from the end that its own sign favours (sorted
access), scores every row it meets for the first time in full (random access) and stops when the bound - the query's
product with the components the walk has reached - is below its k-th score so far: no unseen row can enter. Each query
searches one block first; the k-th score it finds there is its floor in all other blocks, which may stop below it.
The best k of all blocks are the exact top k.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
neither as queries nor as candidates. Vectors meet only vectors of the same length. A query is compared with every
row but those of its own id; identical query rows are answered once, rows of one id with different vectors each have a
ranking of their own; repeated candidate rows count each. Scores are exact whole numbers, whatever the size of the
components; one beyond the range of a long is ranked by its true value and returned as the nearest long. Ties go to
the smaller id. Fewer than k candidates are all returned. Columns other than id and vector are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tidelog.llm.common import stored

#: Candidates and queries in one block; a task holds a block of each.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: List entries read per dimension in a query's first round; rounds double.
FIRST_ROUND = 16
LONG = 1 << 63


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as long where that is safe, else as Python integers."""
    if not x.size or np.abs(x).max() < 2**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    each = [(int(v * scale // 1) if abs(v) < 2**52 / scale else int(v) * scale) for v in x.ravel().tolist()]
    return np.array(each, object).reshape(x.shape)


def exact_matrix(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 where all products and sums are whole numbers below 2^53, else as integers."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    kind = np.float64 if most < 2**53 else np.int64 if most < LONG and x.dtype != object and y.dtype != object else object
    return x.astype(kind), y.astype(kind)


def threshold_search(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of a block, as far as they reach ``floor``, a score that k other rows have.

    ``lists`` holds the row numbers by ascending component.
    """
    n, dims = rows.shape
    active = np.flatnonzero(query != 0)
    if not len(active):
        active = np.zeros(1, np.int64)
    down = query[active] > 0
    weight = query[active]
    seen = np.zeros(n, bool)
    best_ids, best = np.zeros(0, ids.dtype), np.zeros(0, rows.dtype)
    depth, step = 0, FIRST_ROUND
    while depth < n:
        reached = min(n, depth + step)
        low = lists[active[~down], depth:reached]
        high = lists[active[down], n - reached : n - depth]
        found = np.zeros(n, bool)
        found[low.ravel()] = True
        found[high.ravel()] = True
        new = np.flatnonzero(found & ~seen)
        seen |= found
        new = new[ids[new] != own]
        if len(new):
            best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, rows[new] @ query])
            if len(best) > k:
                if best.dtype != object and len(best) > 8 * k:
                    some = best >= np.partition(best, len(best) - k)[len(best) - k]
                    best_ids, best = best_ids[some], best[some]
                order = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[order], best[order]
        frontier = np.where(down, rows[lists[active, n - reached], active], rows[lists[active, reached - 1], active])
        bound = (weight * frontier).sum()
        if len(best) == k and bound < best.min() or floor is not None and bound < floor:
            break
        depth, step = reached, step * 2
    return best_ids, best


def sorted_blocks(rows: DataFrame) -> DataFrame:
    """One row per block of ``rows``: length ``d``, number ``block``, ``ids``, ``x`` (the vectors) and their sorted ``lists``."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def build(part: pa.Table) -> pa.Table:
        x = np.asarray(part.column("v").combine_chunks().flatten()).reshape(part.num_rows, -1)
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        parts = [np.asarray(part.column("id"), np.int64), x, lists]
        return pa.table([part.column("d").slice(0, 1), part.column("block").slice(0, 1), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=["d", "block", "ids", "x", "lists"])

    dealt = rows.withColumn("d", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("d", "block").applyInArrow(build, "d int, block int, ids binary, x binary, lists binary"), "topk-blocks")


def beyond(score: int) -> str:
    """A text that orders scores which the range of a long makes alike."""
    if -LONG <= score < LONG:
        return "5"
    digits = str(abs(score))
    told = f"{len(digits):05d}{digits}"
    return "9" + told if score > 0 else "1" + "".join(str(9 - int(c)) for c in told)


SCORES = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])


def searched(blocks: DataFrame, asked: DataFrame, k: int, scale: int) -> DataFrame:
    """``q``, ``vec_id``, ``score`` and ``beyond`` of each query's best rows in the blocks it is ``asked`` of.

    ``asked`` has a row per query and block: ``d``, ``block``, ``team``, ``q``, ``id``, ``v`` and ``floor``.
    """
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if left.num_rows and right.num_rows:
            d, raw = left.column("d")[0].as_py(), [left.column(c)[0].as_py() for c in ("ids", "x", "lists")]
            ids, x, lists = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1]).reshape(-1, d), np.frombuffer(raw[2], np.int32).reshape(d, -1)
            asks = np.asarray(right.column("v").combine_chunks().flatten()).reshape(-1, d)
            x, asks = exact_matrix(whole(x, scale), whole(asks, scale))
            for q, own, floor, query in zip(*(right.column(c).to_pylist() for c in ("q", "id", "floor")), asks, strict=True):
                best, scores = threshold_search(query, own, x, ids, lists, k, floor)
                scores = [int(s) for s in scores.tolist()]
                for column, values in zip(found, ([q] * len(scores), best.tolist(), [max(-LONG, min(LONG - 1, s)) for s in scores], map(beyond, scores)), strict=True):
                    column += values
        return pa.table([pa.array(c, f.type) for c, f in zip(found, SCORES, strict=True)], schema=SCORES)

    teams = asked.select(F.col("d").alias("_d"), F.col("block").alias("_b"), F.col("team").alias("_t")).distinct()
    mine = blocks.join(teams, (F.col("d") == F.col("_d")) & (F.col("block") == F.col("_b"))).select("_d", "_b", "_t", "d", "ids", "x", "lists")
    return mine.groupBy("_d", "_b", "_t").cogroup(asked.groupBy("d", "block", "team")).applyInArrow(search, "q long, vec_id long, score long, beyond string")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best rows of ``vectors``."""
    blocks = sorted_blocks(usable(vectors, key, vector))
    asked = stored(usable(queries, key, vector).distinct().withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    teams = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.withColumn("d", F.size("v")).withColumn("team", F.pmod(F.xxhash64("q"), F.lit(teams)).cast("int"))
    # a query's first block is one of those with vectors of its length, by hash
    by_length = blocks.groupBy("d").agg(F.array_sort(F.collect_list("block")).alias("all"))  # numbers of blocks
    dealt = asked.join(by_length, "d").withColumn("first", F.element_at("all", (F.pmod(F.xxhash64("q", "id"), F.size("all")) + 1).cast("int")))
    first = stored(searched(blocks, dealt.withColumn("block", F.col("first")).withColumn("floor", F.lit(None).cast("long")), k, scale), "topk-first")
    sure = first.filter("beyond = '5'").groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
    rest = dealt.join(sure, "q", "left").withColumn("block", F.explode(F.array_remove("all", F.col("first"))))
    best = first.unionByName(searched(blocks, rest, k, scale))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
