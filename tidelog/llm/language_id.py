"""Language ID: language family first, then one-versus-one linear support vector machines within it.

Features are shares of hashed byte trigrams of the whole lower-cased text. Every decision (between families,
and between the languages of a family) is made by one-versus-one linear SVMs: most wins, then the larger sum
of margins, then the smaller name.

Defined results: a null text or one without any letter is ``und`` with score 0; with nothing to learn from,
every text is ``und``; with one learned language, that language with score 1. Rows repeat as they came.
``lang_pred`` and ``score`` columns of the input are replaced; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tidelog.llm import words
from tidelog.llm.common import bounded_share, fresh, settings

#: Language families (fixed values). A language that is not listed forms the family ``other``.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sr", "uk"),
}
BUCKETS = 2048
#: Most labelled documents per language that the machines are fitted on.
MAX_PER_LANGUAGE = 2000
#: A duel's texts reach their worker in small batches, which neither side has to hold whole twice.
WHILE_FITTING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
UND = "und"


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def family_of(lang: str) -> str:
    return next((family for family, members in FAMILIES.items() if lang in members), "other")


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of every byte trigram; runs of white space count as single blanks."""
    low = words._LOWER[data]
    space = words._IS_SPACE[low]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    low, owner = np.where(space, 32, low)[keep].astype(np.uint32), owner[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)
    same = owner[:-2] == owner[2:]
    return (code >> np.uint32(21))[same].astype(np.int64), owner[:-2][same]


def trigram_shares(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """``keep``, ``buckets`` and ``shares``: per row the trigram buckets that it has, ascending, and the share, in percent, of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text", words.SMALL_SLICE):
                bucket, owner = _trigrams(data, offsets)
                for first in range(0, part.num_rows, 256):
                    n = min(256, part.num_rows - first)
                    a, b = np.searchsorted(owner, [first, first + n])
                    dense = np.bincount((owner[a:b] - first) * BUCKETS + bucket[a:b], minlength=n * BUCKETS).reshape(n, BUCKETS)
                    dense = 100.0 * dense / np.maximum(dense.sum(axis=1, keepdims=True), 1)
                    row, at = np.nonzero(dense)
                    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int16), dense[row, at].astype(np.float32))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(first, n) for c in keep), *lists], [*keep, "buckets", "shares"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(t)) for c, t in (("buckets", T.ShortType()), ("shares", T.FloatType()))])
    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(rows, schema)


class LanguageModel:
    """``duels``: (group, one name, other name) -> (weights, intercept); positive margins are for the first."""

    def __init__(self, languages: list[str], duels: dict[tuple[str, str, str], tuple[np.ndarray, float]]):
        self.languages, self.duels = languages, duels

    def choose(self, group: str, names: list[str], margins: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its least margin) of n texts."""
        wins, sums, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for a, b in combinations(range(len(names)), 2):
            m = margins[group, names[a], names[b]]
            for k, v in ((a, m), (b, -m)):
                wins[k] += v > 0
                sums[k] += v
                least[k] = np.minimum(least[k], v)
        order = np.lexsort((np.broadcast_to(np.arange(len(names))[:, None], wins.shape), -sums, -wins), axis=0)[0]
        return order, least[order, np.arange(n)]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.languages:
            return [UND] * n, np.zeros(n)
        bucket, owner = _trigrams(data, offsets)
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        margins = {k: 100.0 * np.bincount(owner, weights=w[bucket], minlength=n) / total + b for k, (w, b) in self.duels.items()}
        families = sorted({family_of(x) for x in self.languages})
        family, sure = self.choose("", families, margins, n)
        names, score = np.empty(n, dtype=object), np.zeros(n)
        for i, group in enumerate(families):
            members = [x for x in self.languages if family_of(x) == group]
            best, least = self.choose(group, members, margins, n)
            own = family == i
            names[own] = np.array(members, dtype=object)[best[own]]
            score[own] = np.minimum(least, sure)[own]
        return list(names), 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", max_per_language: int = MAX_PER_LANGUAGE,
                       iterations: int = 150, reg: float = 0.01) -> LanguageModel:
    """Fit on texts with letters and a non-null language, at most about ``max_per_language`` of each."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(counts)
    if len(languages) < 2:
        return LanguageModel(languages, {})
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, bounded_share(counts[k], max_per_language))])
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < share[F.col("lang")] * (1 << 24))
    families = sorted({family_of(x) for x in languages})
    groups = {"": families} | {f: [x for x in languages if family_of(x) == f] for f in families}
    sides = {lang: [(g, a, b, lang == a or family_of(lang) == a) for g, names in groups.items() for a, b in combinations(names, 2)
                    if (family_of(lang) if g == "" else lang) in (a, b)] for lang in languages}
    duel = T.StructType([T.StructField(c, T.StringType()) for c in ("team", "a", "b")] + [T.StructField("first", T.BooleanType())])
    known = duels_by_language(picked.sparkSession, sides, duel)
    train = trigram_shares(picked.repartition(24)).join(F.broadcast(known), "lang").drop("lang")

    def fit(part: pa.Table) -> pa.Table:
        y = np.where(np.asarray(part.column("first")), 1.0, -1.0).astype(np.float32)
        w, bias = squared_hinge_in_place(dense_shares(part), y, reg, iterations)
        key = [part.column(c).slice(0, 1).combine_chunks() for c in ("team", "a", "b")]
        return pa.table([*key, pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias])], names=["team", "a", "b", "w", "bias"])

    fitted = train.groupBy("team", "a", "b").applyInArrow(fit, "team string, a string, b string, w array<double>, bias double")
    with settings(picked.sparkSession, WHILE_FITTING):
        duels = {(r["team"], r["a"], r["b"]): (np.array(r["w"]), r["bias"]) for r in fitted.collect()}  # one row per pair of names
    for group, names in groups.items():  # a pair without usable texts is a draw
        for a, b in combinations(names, 2):
            duels.setdefault((group, a, b), (np.zeros(BUCKETS), 0.0))
    return LanguageModel(languages, duels)


def duels_by_language(spark: SparkSession, sides: dict, duel: T.StructType) -> DataFrame:
    """The duels that texts of each language take part in, and on which side; a row per language and duel."""
    schema = T.StructType([T.StructField("lang", T.StringType()), *duel.fields])
    return spark.createDataFrame([(lang, *d) for lang, own in sides.items() for d in own], schema)


def dense_shares(part: pa.Table) -> np.ndarray:
    """A duel's features, a row per text, with a last column to spare: the only dense copy, for an executor runs several duels at once."""
    z, first = np.zeros((part.num_rows, BUCKETS + 1), np.float32), 0
    for batch in part.select(["buckets", "shares"]).to_batches():
        buckets, shares = batch.columns
        row = np.repeat(np.arange(first, first + batch.num_rows), np.asarray(buckets.value_lengths()))
        z[row, np.asarray(buckets.flatten())] = np.asarray(shares.flatten())
        first += batch.num_rows
    return z


def squared_hinge(x: np.ndarray, y: np.ndarray, reg: float, iterations: int) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss on standardised columns, by accelerated gradient descent."""
    z = np.empty((len(x), x.shape[1] + 1), np.float32)
    z[:, :-1] = x
    return squared_hinge_in_place(z, y, reg, iterations)


def squared_hinge_in_place(z: np.ndarray, y: np.ndarray, reg: float, iterations: int) -> tuple[np.ndarray, float]:
    """``squared_hinge`` of all columns but the last; ``z`` is overwritten."""
    x = z[:, :-1]
    mean, z[:, -1] = x.mean(axis=0), 1
    x -= mean
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / np.float32(len(x))) + np.float32(1e-3)
    x /= scale
    v = np.ones(z.shape[1], np.float32)
    for _ in range(15):  # the largest curvature bounds the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (2 * float(np.linalg.norm(z @ v)) ** 2 / len(z) + reg)
    weight = np.where(y > 0, len(y) / (2 * max(int((y > 0).sum()), 1)), len(y) / (2 * max(int((y < 0).sum()), 1))).astype(np.float32)
    w, ahead = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32)
    for k in range(iterations):
        short = np.maximum(0, 1 - y * (z @ ahead)) * weight
        new = ahead - step * (-2 * (z.T @ (y * short)) / len(z) + reg * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    plain = w[:-1] / scale
    return plain.astype(np.float64), float(w[-1] - plain @ mean)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row, from the whole text alone."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, text, words.SMALL_SLICE):
                lang, score = model.predict(data, offsets)
                letters = np.asarray(part.column(has))
                lang = [x if ok else UND for x, ok in zip(lang, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], schema.names)

    has = fresh(docs, "_letters")
    return docs.withColumn(has, has_letter(F.col(text))).mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_determined_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that get a language when those not held out are learned from; where nothing can be learned, those with letters."""
    model = fit_language_model(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(has_letter(F.col("text")))
    return with_language(docs, model).filter(F.col("lang_pred") != UND).select(*docs.columns)
