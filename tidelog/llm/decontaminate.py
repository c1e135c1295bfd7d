"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

Words are lower-cased (A-Z) runs of letters and digits. Seeds are rare n-grams: of an item of more than SHORT words every
three words in a row, and every four in the shape two, one left out, two, which a copy with each third word replaced
still has. Of a shorter item, where a few edits leave little, they are three words in any of five shapes, whatever shape
they have in the document: a word put in or taken out makes one shape of another. Items of three words have
pairs. All seeds of an item count, however frequent: which of them an edited copy keeps is not known before. A filter of fixed size finds the places of documents that may hold a seed; an equi-join on it confirms them. Around the seeds, as far as an item can reach, the
words of the document are aligned with those of the item; the score is the best local alignment's, as a share of the
item's own.

Defined results: null and empty texts score 0; items with one or two words hold no seed and match nothing;
repeated items count once each; repeated documents each get a row. ``item_id`` is the best item, ties to the
smaller id; it is null where no item shares a seed. Columns other than the ids and texts are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidelog.llm import words
from tidelog.llm.common import fresh, placed, stored

#: Places of a seed's words, counted from its first one, for long items, for those of SHORT words or less, and for those of
#: three words. Seeds of short items are told apart by their salt.
SHORT = 10
LONG_SHAPES = ((0, 1, 2), (0, 1, 3, 4))
SHORT_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 3, 4))
PAIRS = ((0, 1), (0, 2))
SALT = 1000
#: Alignment: what a pair of equal words adds, what others and gaps cost; share of an item's own score to report.
MATCH, MISMATCH, GAP, MIN_SCORE = 1.0, 0.5, 0.5, 0.5
#: Item words after which the words of a document around a seed are no longer an item's.
REACH = 1.5


def seeds_of(h: np.ndarray, owner: np.ndarray, shapes: tuple[tuple[int, ...], ...], salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash of its words) of every seed of texts, by place."""
    places, seeds = [], []
    for shape in shapes:
        m = max(len(h) - shape[-1], 0)
        whole = np.flatnonzero(owner[:m] == owner[len(h) - m :])
        seed = np.full(len(whole), len(shape) + salt, np.uint64)
        for step in shape:
            seed = seed * words._STEP + h[whole + step]
        places.append(whole)
        seeds.append(words.mixed(seed))
    place, seed = np.concatenate(places), np.concatenate(seeds)
    order = np.argsort(place, kind="stable")
    return place[order], seed[order]


def item_words(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (row number), ``item_id``, ``words`` and n-gram hashes ``grams`` of each test item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text", words.SMALL_SLICE):
                h, owner = words.word_hashes(data, offsets, words.PUNCTUATION)
                count = np.arange(part.num_rows + 1)
                size = np.diff(np.searchsorted(owner, count))
                found = []
                for shapes, salt, fits in ((LONG_SHAPES, 0, size > SHORT), (SHORT_SHAPES, SALT, size <= SHORT), (PAIRS, SALT, size == 3)):
                    at, seed = seeds_of(h, owner, shapes, salt)
                    own = fits[owner[at]]
                    found.append((seed[own], owner[at[own]]))
                grams, of = (np.concatenate(x) for x in zip(*found, strict=True))
                grams, of = grams[order := np.argsort(of, kind="stable")], of[order]
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(o, count).astype(np.int32)), pa.array(x.view(np.int64))) for x, o in ((h, owner), (grams, of))]
                yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), *lists], ["item", "item_id", "words", "grams"])

    own = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    return own.mapInArrow(rows, "item long, item_id long, words array<long>, grams array<long>")


def seed_filter(grams: DataFrame) -> words.HashFilter:
    """A filter over the column ``gram``, made in the tasks; what comes back has a fixed size each."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = words.HashFilter()
        for batch in batches:
            mine.add(np.asarray(batch.column("gram")).view(np.uint64))
        at = np.flatnonzero(mine.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mine.words[at].view(np.int64))], ["at", "bits"])

    parts = grams.select("gram").coalesce(8).mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = words.HashFilter()
    table = parts.toArrow()  # at most 2^21 words
    found.words[np.asarray(table.column("at"))] = np.asarray(table.column("bits")).view(np.uint64)
    return found


def item_seeds(items: DataFrame) -> DataFrame:
    """``item``, ``gram``: every distinct n-gram of each item."""
    return items.select("item", F.explode(F.array_distinct("grams")).alias("gram"))


def passages(docs: DataFrame, keep: words.HashFilter, reach: int, shapes: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """Per document with a possible seed: ``row``, ``part`` number, ``words`` around seeds and the ``grams``."""
    span = 1 + max(shape[-1] for shape, _ in shapes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text", words.SMALL_SLICE):
                h, owner = words.word_hashes(data, offsets, words.PUNCTUATION)
                found = []
                for shape, salt in shapes:  # one at a time: few seeds of a shape pass
                    place, seed = seeds_of(h, owner, (shape,), salt)
                    some = np.flatnonzero(keep.passing(seed))
                    found.append((place[some], seed[some]))
                hits, grams = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(hits):
                    continue
                order = np.argsort(hits, kind="stable")
                hits, grams = hits[order], grams[order]
                bounds = np.searchsorted(owner, [owner[hits], owner[hits] + 1])
                first, last = np.maximum(hits - reach, bounds[0]), np.minimum(hits + span + reach, bounds[1])
                new = np.concatenate([[True], (first[1:] > last[:-1]) | (owner[hits[1:]] != owner[hits[:-1]])])
                group = np.flatnonzero(new)
                ends = last[np.concatenate([group[1:] - 1, [len(hits) - 1]])]
                taken = [h[a:b] for a, b in zip(first[group], ends, strict=True)]
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in taken])]).astype(np.int32)
                ids = part.column("row").take(pa.array(owner[hits[group]]))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(first[group].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(taken).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.append(group, len(hits)).astype(np.int32)), pa.array(grams.view(np.int64)))], ["row", "part", "words", "grams"])

    return docs.select("row", "text").mapInArrow(rows, "row long, part long, words array<long>, grams array<long>")


def local_alignment(item: np.ndarray, text: np.ndarray) -> float:
    """The best Smith-Waterman score of two word sequences; a row of the table at a time."""
    cost = GAP * np.arange(len(text) + 1)
    row, best = np.zeros(len(text) + 1), 0.0
    for word in item:
        step = np.maximum(row - GAP, 0.0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(text == word, MATCH, -MISMATCH))
        row = np.maximum.accumulate(step + cost) - cost
        best = max(best, float(row.max()))
    return best


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(batch.column("item_words"), batch.column("words"), strict=True)]
        score = [local_alignment(a, b) / (MATCH * len(a)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(score, pa.float64())], ["row", "item_id", "score"])


def best_items(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``row``, ``item_id`` and ``score`` of the rows (``row``, ``text``) that share a seed with an item."""
    items = stored(item_words(benchmark), "items")
    seeds = stored(item_seeds(items), "seeds")
    n = F.size("words")
    longest, short, tiny = items.agg(F.max(n), F.count_if(n.between(3, SHORT)), F.count_if(n == 3)).first()
    shapes = [*((x, 0) for x in LONG_SHAPES), *((x, SALT) for x in SHORT_SHAPES if short), *((x, SALT) for x in PAIRS if tiny)]
    found = stored(passages(rows, seed_filter(seeds), int(REACH * (longest or 0)), shapes), "passages")
    hits = found.select("row", "part", F.explode("grams").alias("gram")).join(seeds, "gram").select("row", "part", "item").distinct()
    # the words of a passage and of an item meet once per pair that shares a seed
    pairs = hits.join(found.select("row", "part", "words"), ["row", "part"]).join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    scored = pairs.select("row", "item_id", "item_words", "words").mapInArrow(_scores, "row long, item_id long, score double")
    return scored.groupBy("row").agg(F.min_by("item_id", F.struct(-F.col("score"), F.col("item_id"))).alias("item_id"), F.max("score").alias("score"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``key``, ``item_id``, ``score`` and ``contaminated`` of every document."""
    at = fresh(docs, "row")
    rows = placed(docs, at).select(F.col(at).alias("row"), F.col(key).alias("_key"), F.col(text).alias("text"))
    best = best_items(rows.select("row", "text"), benchmark)
    out = rows.select("_key", "row").join(best, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select(F.col("_key").alias(key), "item_id", "score", (F.col("score") >= min_score).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item or edited copy of one."""
    at = fresh(docs, "_at")
    rows = placed(docs, at)
    best = best_items(rows.select(F.col(at).alias("row"), F.col(text).alias("text")), benchmark)
    goes = stored(best.filter(F.col("score") >= min_score).select(F.col("row").alias(at)), "contaminated")
    return rows.join(goes, at, "left_anti").drop(at)
