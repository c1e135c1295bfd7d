"""Language-model scores: stupid backoff over n-gram counts of the corpus, computed relationally.

score(w | context) = count(context w) / count(context) where the n-gram is kept (counted MIN_COUNT times or more),
else ALPHA * score(w | shorter context), down to count(w) / N. Written as logarithms, every kept n-gram changes the
score of a place by a value of its own: v = log c(1..n) - log c(1..n-1) - log ALPHA - (log c(2..n) - log c(2..n-1)).
So a document's score is the sum of its words' values and of the values of its kept n-grams: count tables by n-gram
hash give a value table, the documents' exploded n-grams join it on the hash and are summed per document.

Where the documents are the corpus themselves and all n-grams are kept, no place backs off. A document's logarithms
then telescope to those of its n-grams' counts, less those of the (n-1)-grams within it (neither first nor last) and
log N; with fewer than n words, to the count of its words as one, less log N. N-grams seen once add log 1 = 0, so
only the others are joined, and the scores are exact.

Tables are partitioned by hash. Counts are summed within a task before they are shuffled, so a very common n-gram is
an entry per task; those of two words or more travel packed by parts of the hashes, not a row per n-gram. Documents send
each distinct n-gram once with its number, only those that a filter of fixed size takes for kept, and not the HEAD most
frequent, whose values all tasks hold. Orders run one after another.

Defined results: words as everywhere here (A-Z lower-cased); null and empty texts have n_words 0, log_prob 0 and null
per_word and perplexity; repeated rows count and are scored each; scores don't depend on ids. Other columns
than id and text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.llm import words
from tidelog.llm.common import fresh, placed, stored

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
#: Distinct n-grams that a task adds up before it passes their counts on.
HELD = 4_000_000
#: Places whose n-grams are added up together.
PART = 1 << 20
#: Pieces in which filters travel.
PIECES = 64
#: Most frequent n-grams of an order whose values go to all tasks.
HEAD = 1 << 17


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return words.ngram_hashes(*words.word_hashes(data, offsets), n)


def ngram_counts(docs: DataFrame, n: int, least: int = 1, total: int | None = None) -> DataFrame:
    """``h``, ``c`` of every n-gram of ``text`` that is counted ``least`` times or more; ``total`` is the number of words.

    Tasks pass on sums by hash. Words are few, so Spark adds up theirs. Longer n-grams, most of them met once, travel
    packed, a row for each part of the hashes; a part has some PART places, so as many parts as the texts need.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in words.slices(batch, "text"):
                held.append(_grams(data, offsets, n)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield summed(np.sort(np.concatenate(held)))
                    held, size = [], 0
        if size:
            yield summed(np.sort(np.concatenate(held)))

    def summed(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[first], np.diff(np.append(first, len(h))) if c is None else np.add.reduceat(c, first)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in within(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    if total is None:
        return docs.select("text").mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = math.ceil(math.log2(max(total / PART, 4 * partitions, 2)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in within(batches):
            for at in range(0, len(h), HELD):  # a very long text may bring more
                yield by_part(h[at : at + HELD], c[at : at + HELD].astype(np.int32))

    def by_part(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        part = (h >> np.uint64(64 - bits)).astype(np.int32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        cuts = np.append(first, len(h))
        raw = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (h, c)]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), *raw], ["part", "hashes", "counts"])

    def across(part: pa.Table) -> pa.Table:
        h, c = (np.frombuffer(b"".join(part.column(x).to_pylist()), kind) for x, kind in (("hashes", np.uint64), ("counts", np.int32)))
        order = np.argsort(h, kind="stable")  # runs of sorted hashes
        h, c = summed(h[order], c[order].astype(np.int64))
        return pa.table([pa.array(h[c >= least].view(np.int64)), pa.array(c[c >= least])], names=["h", "c"])

    runs = docs.select("text").mapInArrow(packed, "part int, hashes binary, counts binary")
    return runs.groupBy("part").applyInArrow(across, "h long, c long")


def kept_filter(table: DataFrame) -> words.HashFilter:
    """A filter of fixed size that passes every ``h`` of the table, put together from the tasks' by pieces."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = words.HashFilter()
        for batch in batches:
            mine.add(np.asarray(batch.column("h")).view(np.uint64))
        pieces = mine.words.reshape(PIECES, -1)
        some = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pieces[i].tobytes() for i in some], pa.binary())], ["piece", "bits"])

    def either(same: pa.Table) -> pa.Table:
        found = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in same.column("bits").to_pylist()])
        return pa.table([same.column("piece").slice(0, 1), pa.array([found.tobytes()], pa.binary())], names=["piece", "bits"])

    found = words.HashFilter()
    pieces = found.words.reshape(PIECES, -1)
    table = table.select("h").coalesce(8).mapInArrow(bits, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").toArrow()
    for piece, raw in zip(*(table.column(c).to_pylist() for c in ("piece", "bits")), strict=True):
        pieces[piece] = np.frombuffer(raw, np.uint64)
    return found


def ngram_parts(docs: DataFrame, n: int, keep: words.HashFilter) -> DataFrame:
    """``h`` of the kept n-grams, with the hashes of their first and last n - 1 words and the n - 2 between.

    Tasks pass an n-gram's hash and outer words on, once for every HELD places; the other hashes follow from these.
    """
    names = ["h", "first", "last"][: 2 if n == 2 else 3]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in words.slices(batch, "text"):
                w, owner = words.word_hashes(data, offsets)
                m = len(w) - n + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(owner[:m] == owner[n - 1 :])
                h = words.ngram_hashes(w, owner, n)[0]
                some = np.flatnonzero(keep.passing(h))
                held.append([h[some], w[at[some]], w[at[some] + n - 1]][: len(names)])
                size += len(some)
                if size >= HELD:
                    yield first_of_each(held)
                    held, size = [], 0
        if held:
            yield first_of_each(held)

    def distinct(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        _, first = np.unique(columns[0], return_index=True)
        return [c[first] for c in columns]

    def first_of_each(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in distinct(held)], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(b.column(c)).view(np.uint64) for c in names] for b in batches]
        if held:
            h, first, *last = distinct(held)
            parts = [h, *words.inner_hashes(h, first, last[0] if last else None, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in parts], ["h", "head", "tail", "middle"])

    schema = ", ".join(f"{c} long" for c in names)
    return docs.select("text").mapInArrow(within, schema).repartition("h").mapInArrow(across, "h long, head long, tail long, middle long")


class Head:
    """The values of the most frequent n-grams, at most HEAD of them: these never pass a shuffle."""

    def __init__(self, table: DataFrame):
        rows = table.orderBy(F.col("c").desc(), "h").limit(HEAD).select("h", "v").toArrow()
        h, v = np.asarray(rows.column("h")).view(np.uint64), np.asarray(rows.column("v"))
        order = np.argsort(h)
        self.h, self.v = np.append(h[order], np.uint64(0)), np.append(v[order], 0.0)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is among them, its value or 0)."""
        at = np.searchsorted(self.h[:-1], h)
        known = (self.h[at] == h) & (at < len(self.h) - 1)
        return known, np.where(known, self.v[at], 0.0)


def place_signs(owner: np.ndarray, n_words: np.ndarray, n: int, order: int) -> np.ndarray:
    """How often the logarithm of an n-gram's count adds to its text's score, by place, when no place backs off."""
    if n == order or not len(owner):
        return np.ones(len(owner), np.int64)
    signs = (n_words[owner] == n).astype(np.int64)  # the text as one
    if n == order - 1:
        edge = owner[1:] != owner[:-1]
        signs -= ~(np.append(True, edge) | np.append(edge, True))
    return signs


def document_sums(docs: DataFrame, n: int, keep: words.HashFilter | None, values: DataFrame, order: int | None = None) -> DataFrame:
    """``row``, ``v`` (the values of a document's n-grams, summed) and ``n_words``, of ``values`` (``h``, ``c``, ``v``).

    A document's distinct n-grams go to the value table by hash, each with its number; those of the head are added
    up where the document is read, in a row of its own. With ``order``, places count by ``place_signs``.
    """
    head = Head(values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text"):
                w, own = words.word_hashes(data, offsets)
                n_words = np.bincount(own, minlength=part.num_rows)
                h, owner = words.ngram_hashes(w, own, n)
                signs = place_signs(owner, n_words, n, order or n)
                some = signs != 0
                if keep is not None:
                    some &= keep.passing(h)
                h, owner, signs = h[some], owner[some], signs[some]
                known, v = head.find(h)
                summed = np.bincount(owner, weights=v * signs, minlength=part.num_rows)
                h, owner, signs = h[~known], owner[~known], signs[~known]
                codes, _ = pd.factorize(words.mixed(h + owner.astype(np.uint64) * words._RADIX))
                first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1) > 0) if len(codes) else codes
                k = np.bincount(codes, weights=signs, minlength=len(first))
                ids = part.column("row")
                every = np.arange(part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.concatenate([every, owner[first]]))), pa.array(np.concatenate([words.mixed(np.asarray(ids).view(np.uint64)), h[first]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(part.num_rows, np.int32), k.astype(np.int32)])), pa.array(np.concatenate([summed, np.zeros(len(first))])),
                    pa.array(np.concatenate([n_words, np.zeros(len(first), n_words.dtype)]).astype(np.int32))], ["row", "h", "k", "own", "n_words"])

    # a document's own row has k = 0: its h only spreads such rows over the partitions
    found = docs.select("row", "text").mapInArrow(rows, "row long, h long, k int, own double, n_words int")
    joined = found.join(values.select("h", F.col("v").alias("w")).hint("shuffle_hash"), "h", "left")
    return joined.groupBy("row").agg(F.sum(F.col("own") + F.coalesce(F.col("k") * F.col("w"), F.lit(0.0))).alias("v"), F.sum("n_words").alias("n_words"))


def whole_model_sums(rows: DataFrame, order: int) -> DataFrame:
    """``row``, ``v`` (log_prob) and ``n_words`` under the model of all n-grams of the rows themselves."""
    every = stored(ngram_counts(rows, 1), "counts-1")
    total = every.agg(F.sum("c")).first()[0] or 1
    added = None
    for n in range(1, order + 1):
        counts = every.filter("c > 1") if n == 1 else stored(ngram_counts(rows, n, 2, total), f"counts-{n}")
        values = counts.withColumn("v", F.log(F.col("c").cast("double")))
        found = stored(document_sums(rows, n, None if n == 1 else kept_filter(counts), values, order), f"sums-{n}")
        found = found.withColumn("n_words", F.col("n_words") if n == 1 else F.lit(0).cast("bigint"))
        added = found if added is None else added.unionByName(found)
    both = added.groupBy("row").agg(F.sum("v").alias("v"), F.sum("n_words").alias("n_words"))
    return both.withColumn("v", F.when(F.col("n_words") > 0, F.col("v") - math.log(total)).otherwise(0.0))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", corpus: DataFrame | None = None,
              order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``key``, ``n_words``, ``log_prob`` (natural), ``per_word`` and ``perplexity`` of every document.

    Counts come from all of ``corpus`` (``text``; by default the documents themselves). A word that the corpus
    lacks counts as if seen once. With ``min_count`` 1 every n-gram of the corpus is kept.
    """
    at = fresh(docs, "row")
    rows = placed(docs, at).select(F.col(at).alias("row"), F.col(key).alias("_key"), F.col(text).alias("text"))
    if corpus is None and min_count <= 1 and order > 1:
        return scored(rows.join(whole_model_sums(rows, order), "row"), F.col("v"), key)
    source = rows if corpus is None else corpus.select(F.col(text).alias("text"))
    counts = {1: stored(ngram_counts(source, 1), "counts-1")}
    total = counts[1].agg(F.sum("c")).first()[0] or 1
    log = lambda c: F.log(F.col(c).cast("double"))
    unseen = -math.log(total)
    # a word that the corpus lacks joins nothing: every word has this value, known ones the rest
    sums = [stored(document_sums(rows, 1, None, counts[1].withColumn("v", log("c"))), "sums-1")]
    for n in range(2, order + 1):
        counts[n] = stored(ngram_counts(source, n, min_count, total), f"counts-{n}")
        keep = kept_filter(counts[n])
        parts = stored(ngram_parts(source, n, keep), f"parts-{n}").join(counts[n].hint("shuffle_hash"), "h")
        for side in ("head", "tail"):
            parts = parts.join(counts[n - 1].select(F.col("h").alias(side), F.col("c").alias(f"c_{side}")).hint("shuffle_hash"), side)
        if n > 2:
            parts = parts.join(counts[n - 2].select(F.col("h").alias("middle"), F.col("c").alias("c_middle")).hint("shuffle_hash"), "middle")
        else:
            parts = parts.withColumn("c_middle", F.lit(total))
        values = stored(parts.select("h", "c", (log("c") - log("c_head") - math.log(alpha) - log("c_tail") + log("c_middle")).alias("v")), f"values-{n}")
        sums.append(stored(document_sums(rows, n, keep, values).select("row", "v", F.lit(0).cast("bigint").alias("n_words")), f"sums-{n}"))
    added = sums[0]
    for s in sums[1:]:
        added = added.unionByName(s)
    out = rows.select("_key", "row").join(added.groupBy("row").agg(F.sum("v").alias("v"), F.sum("n_words").alias("n_words")), "row")
    # each place backs off from the longest context it has: min(place, order - 1) words
    backoffs = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, order)), F.lit(0))
    return scored(out, F.col("v") + F.col("n_words") * unseen + backoffs * math.log(alpha), key)


def scored(out: DataFrame, log_prob: Column, key: str) -> DataFrame:
    per_word = F.when(F.col("n_words") > 0, log_prob / F.col("n_words"))
    return out.select(F.col("_key").alias(key), "n_words", log_prob.alias("log_prob"), per_word.alias("per_word"), F.exp(-per_word).alias("perplexity"))
