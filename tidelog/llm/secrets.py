"""Secret scans: fixed base patterns, and character Markov models compared by log-likelihood ratio.

Models of random strings, one per alphabet (``CLASSES``: both cases, hexadecimal, one case with digits, letters of one
case), meet one of ordinary identifiers and words; a token is judged by the random model of its own alphabet, so one of
few symbols isn't measured against one of many. Tokens without lower-case letters are read as lower-case ones. All are
trained from labelled samples: the values that the base patterns find and strings drawn at random from each alphabet,
and those of the other long tokens that change between letters and digits as seldom as words and numbers do. A token is
added when its mean log-likelihood ratio per character pair reaches the threshold of its alphabet and length, which held-out
random samples alone set, by their lowest 4 %: unlabelled secrets among the ordinary ones don't raise it.
All work is DataFrame expressions.

Defined results: a null or empty text has no spans; rows with equal or null ids are scanned one by one; tokens without
letters are never random; without any random sample of its alphabet, or any ordinary sample, no token is added. Columns other than the key and the text are not used.
"""

from __future__ import annotations

import json
import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from tidelog.llm.common import bounded_share, share_below, stored
from tidelog.llm.spans import joined, let, spans, touches, with_matches

#: Kinds in the order of the digests; ``markov`` spans are those that the models add.
KINDS = ("assign", "access", "hex", "markov")
#: Fixed base patterns; possessive where giving back characters could never help.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    "long": r"[A-Za-z0-9+/_.=-]{12,}+",
}
#: Alphabets: both cases; letters a to f of one case and digits; one case and digits; letters of one case.
CLASSES = ("mixed", "hex", "digits", "letters")
#: What is drawn for each: symbols, and after how many of them a dash comes (0: never).
DRAWN = (
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 0), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", 0),
    ("0123456789abcdef", 4), ("0123456789abcdef", 8), ("abcdefghijklmnopqrstuvwxyz0123456789", 0), ("abcdefghijklmnopqrstuvwxyz0123456789", 5), ("abcdefghijklmnopqrstuvwxyz", 0),
)
#: Strings drawn of each, from and to how many symbols.
N_DRAWN, SHORTEST, LONGEST = 3000, 12, 40
#: Lengths from which other thresholds hold, and the share of random samples that a threshold leaves out.
LENGTHS, LEFT_OUT = (16, 24), 0.04
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 1
#: Most tokens of either label that the models count.
MAX_TOKENS = 200_000


def assigned(match: Column) -> Column:
    return F.regexp_extract(match, PATTERNS["assign"], 1)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` spans and ``long`` tokens that no base span overlaps, of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = with_matches(rows, "_text", PATTERNS).withColumns({
        "_0": spans("assign", 0, lambda m: F.length(assigned(m)) >= 12), "_1": spans("access", 1, lambda m: F.lit(True)),
        "_2": spans("hex", 2, lambda m: F.lit(True)), "_3": spans("long", 3, lambda m: F.lit(True))})
    free = let(F.struct("_0", "_1", "_2"), lambda b: F.filter("_3", lambda t: ~(touches(t, b["_0"]) | touches(t, b["_1"]) | touches(t, b["_2"]))))
    return found.select(F.col("_key").alias(key), F.concat("_0", "_1", "_2").alias("base"), free.alias("long"))


def one_case(token: Column) -> Column:
    """A token without lower-case letters in lower case; others as they are."""
    return F.when(F.rlike(token, F.lit("[a-z]")), token).otherwise(F.lower(token))


def class_of(token: Column) -> Column:
    """The number of a token's alphabet in CLASSES, null without letters; ``token`` is of ``one_case``."""
    has = lambda p: F.rlike(token, F.lit(p))
    return F.when(has("[A-Z]"), 0).when(~has("[a-z]"), None).when(~has("[0-9]"), 3).when(has("[g-z]"), 2).otherwise(1)


def changes(token: Column) -> Column:
    """How often a token changes between letters and digits, or between cases otherwise than at a capital that begins a word."""
    return F.regexp_count(token, F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z](?![a-z][a-z]))|(?<=[A-Z][A-Z])(?=[a-z])"))


def is_ordinary(token: Column) -> Column:
    """Whether a token has the form of words and numbers: a change in eight characters at most."""
    return changes(token) * 8 <= F.length(token)


def drawn_tokens(spark: SparkSession, n: int = N_DRAWN) -> DataFrame:
    """``token``: ``n`` strings from each of DRAWN; the same at every run."""
    every = F.array(*[F.struct(F.lit(symbols).alias("symbols"), F.lit(gap).alias("gap")) for symbols, gap in DRAWN])
    draw = lambda i, salt, below: F.pmod(F.xxhash64("id", i, F.lit(salt)), below)
    rows = spark.range(n * len(DRAWN)).select("id", every[(F.col("id") % len(DRAWN)).cast("int")].alias("d")).withColumn("n", (SHORTEST + draw(F.lit(0), 1, F.lit(LONGEST - SHORTEST + 1))).cast("int"))
    symbol = lambda i: F.substring(F.col("d.symbols"), (draw(i, 2, F.length("d.symbols")) + 1).cast("int"), F.lit(1))
    dash = lambda i: F.when((F.col("d.gap") > 0) & (i % (F.col("d.gap") + 1) == 0), F.lit("-"))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(dash(i), symbol(i))), "").alias("token"))


def _cells(token: Column) -> Column:
    """The character pairs of a token as cell numbers of the transition table; the start counts as symbol 0."""
    chars = F.split(token, "")
    codes = F.transform(chars, lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * SYMBOLS + b)


def _pair_logs(counts: dict[int, int], weight: float = 5.0) -> list[float]:
    """log P(symbol | symbol before), drawn towards P(symbol) by ``weight`` pairs; by cell."""
    seen = [0.0] * SYMBOLS
    before = [0.0] * SYMBOLS
    for cell, n in counts.items():
        before[cell // SYMBOLS] += n
        seen[cell % SYMBOLS] += n
    total = sum(seen)
    single = [(x + 1) / (total + SYMBOLS) for x in seen]
    return [math.log((counts.get(i, 0) + weight * single[i % SYMBOLS]) / (before[i // SYMBOLS] + weight)) for i in range(SYMBOLS * SYMBOLS)]


class SecretModel:
    """``ratios``: per alphabet log P(pair | random) - log P(pair | ordinary) by cell; ``thresholds``: least mean to report, by
    alphabet and length."""

    def __init__(self, ratios: list[list[float]] | None, thresholds: dict[tuple[int, int], float] | None = None):
        self.ratios, self.thresholds = ratios, thresholds or {}

    def score(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a token; null where it has no letter."""
        table = F.from_json(F.lit(json.dumps([x for t in self.ratios for x in t])), "array<double>")

        def of(own: Column) -> Column:
            mean = lambda at, cells: F.aggregate(cells, F.lit(0.0), lambda s, c: s + table[at * SYMBOLS * SYMBOLS + c]) / F.greatest(F.size(cells), F.lit(1))
            return let(F.struct(class_of(own).alias("k"), _cells(own).alias("cells")), lambda x: F.when(x["k"].isNotNull(), mean(x["k"], x["cells"])))

        return let(one_case(token), of)

    def is_random(self, token: Column) -> Column:
        """Whether a token's score reaches its threshold."""
        n = len(LENGTHS) + 1
        least = F.from_json(F.lit(json.dumps([self.thresholds.get((k, b), 1e300) for k in range(len(CLASSES)) for b in range(n)])), "array<double>")
        at = let(class_of(one_case(token)), lambda k: least[k * n + length_of(token)])
        return F.coalesce(self.score(token) >= at, F.lit(False))


def length_of(token: Column) -> Column:
    return sum(((F.length(token) >= n).cast("int") for n in LENGTHS), F.lit(0))


def fit_secret_model(labelled: DataFrame, token: str = "token", label: str = "label", max_tokens: int = MAX_TOKENS) -> SecretModel:
    """Fit on tokens labelled 1 (random) and 0 (ordinary), at most about ``max_tokens`` of each label.

    A fifth of the random ones, which the models don't count, sets the thresholds. They are 0 at least, where both models
    find a token equally likely.
    """
    rows = labelled.filter(F.col(token).isNotNull() & (F.col(token) != "") & F.col(label).isin(0, 1)).select(F.col(token).alias("token"), F.col(label).alias("label"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return SecretModel(None)
    shares = [bounded_share(n[k], max_tokens) for k in (0, 1)]
    picked = rows.filter(F.when(F.col("label") == 1, share_below(F.col("token"), shares[1])).otherwise(share_below(F.col("token"), shares[0])))
    picked = stored(picked.withColumn("token", one_case(F.col("token"))).withColumn("k", class_of(F.col("token"))).filter("k is not null"), "secret-sample")
    part = F.pmod(F.xxhash64("token", F.lit(3)), F.lit(5))  # a fifth sets thresholds
    cells = picked.filter(part > 0).select("label", "k", F.explode(_cells(F.col("token"))).alias("cell"))
    counted = cells.groupBy("label", "k", "cell").count().collect()  # at most 2 x 4 x SYMBOLS^2 rows
    ordinary: dict[int, int] = {}
    for r in counted:
        if r["label"] == 0:
            ordinary[r["cell"]] = ordinary.get(r["cell"], 0) + r["count"]
    plain = _pair_logs(ordinary)
    random = [_pair_logs({r["cell"]: r["count"] for r in counted if r["label"] == 1 and r["k"] == k}) for k in range(len(CLASSES))]
    model = SecretModel([[round(a - b, 3) for a, b in zip(own, plain, strict=True)] for own in random])
    judged = picked.filter(part == 0).select("label", "k", length_of(F.col("token")).alias("b"), model.score(F.col("token")).alias("s"))
    low = judged.filter("label = 1").groupBy("k", "b").agg(F.percentile_approx("s", LEFT_OUT, 10000).alias("low"))
    model.thresholds = {(r["k"], r["b"]): max(r["low"], 0.0) for r in low.collect()}  # at most 12 rows
    return model


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", model: SecretModel | None = None) -> DataFrame:
    """Per row ``key``, ``base`` and ``added`` spans (start, stop, kind number, value).

    Without a model one is fitted: base values and ``drawn_tokens`` are the random sample, other long tokens that are
    ``is_ordinary`` the ordinary one.
    """
    found = stored(scanned(docs, key, text), "secret-spans")
    if model is None:
        value = F.when(F.col("b.kind") == 0, assigned(F.col("b.value"))).otherwise(F.col("b.value"))
        random = found.select(F.explode("base").alias("b")).select(value.alias("token"), F.lit(1).alias("label"))
        ordinary = found.select(F.explode("long").alias("t")).filter(is_ordinary(F.col("t.value"))).select(F.col("t.value").alias("token"), F.lit(0).alias("label"))
        drawn = drawn_tokens(docs.sparkSession).withColumn("label", F.lit(1))
        model = fit_secret_model(random.unionByName(drawn).unionByName(ordinary))
    if model.ratios is None:
        added = F.filter("long", lambda t: F.lit(False))
    else:
        added = F.filter("long", lambda t: model.is_random(t["value"]))
    return found.select(key, "base", added.alias("added"))


def secret_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"))
