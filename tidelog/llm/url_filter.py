"""URL filters: explicit host/path rules, and gradient-boosted trees for the URLs no rule decides.

The trees see lexical features only (length, depth, digit ratio, entropy, parameter counts, suffix
statistics) and learn from labelled URLs. Where the caller has no labels of its own, the URLs that the
rules decide are the labelled ones.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; the method judges it by its
other features, like any URL that no rule decides. Repeated rows are judged one by one.
If the labels hold one class only (or none), that class (``allow`` without any) is the method's verdict. Extra columns,
whatever they are called, pass through ``score`` and ``url_verdicts`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from tidelog.llm.common import ascii_lower, bounded_share, share_below, stored
from tidelog.llm.spans import let

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Most labelled URLs that the trees are fitted on; a larger set is thinned by a hash of the URL.
MAX_LABELLED, FOLDS = 200_000, 5
FEATURES = (
    "n_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "host_digits", "hyphens",
    "entropy", "params", "param_chars", "fragment", "odd_chars", "last_chars", "suffix_blocked",
    "suffix_seen",
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    cases = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        cases.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)

    def add(total: Column, char: Column) -> Column:
        return let((n - F.length(F.replace(text, char))) / n, lambda p: total - p * F.log2(p))

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``_host``, ``_path`` and the lexical columns of ``FEATURES`` other than the suffix statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumns({"_host": url_host(F.col(url)), "_path": url_path(F.col(url))})
    host, path = F.col("_host"), F.col("_path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    features = {
        "n_chars": F.length(u), "host_chars": F.length(host), "path_chars": F.length(path),
        "labels": F.regexp_count(host, F.lit(r"\.")), "depth": F.regexp_count(path, F.lit("/[^/]")),
        "digit_ratio": _share(F.regexp_count(u, F.lit("[0-9]")), F.length(u)),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")), "hyphens": F.regexp_count(host, F.lit("-")),
        "entropy": _entropy(u), "params": F.regexp_count(query, F.lit("[^&=]+=")), "param_chars": F.length(query),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "odd_chars": F.regexp_count(u, F.lit("[^A-Za-z0-9/._-]")),
        "last_chars": F.length(F.substring_index(path, "/", -1)),
    }
    return df.withColumns({"_suffix": suffix_of(host)} | {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features.items()})


class UrlModel:
    """Fitted trees plus the suffix statistics; ``constant`` stands in when one class only was seen."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def score(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Add ``p_block``, the probability that a URL is to be blocked."""
        if self.trees is None:
            return df.withColumn("p_block", F.lit(float(self.prior)))
        rows = df.select(F.struct(*df.columns).alias("_row"), F.col(url).alias("url"))
        out = with_suffix_statistics(lexical_features(rows), self.suffixes, self.prior)
        out = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(out))
        return out.select("_row.*", vector_to_array("probability")[1].alias("p_block"))


def with_suffix_statistics(df: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    out = df.join(suffixes, "_suffix", "left")
    return out.withColumns({"suffix_blocked": F.coalesce("suffix_blocked", F.lit(float(prior))), "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0))})


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "label", max_labelled: int = MAX_LABELLED,
                  trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on labelled URLs (label 1: block). At most about ``max_labelled`` rows are used.

    Suffix statistics are smoothed block rates by the last two host labels; a row that the trees learn from gets those
    of the other folds.
    """
    rows = labelled.filter(F.col(label).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    n, blocked = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < blocked < n:
        return UrlModel(None, None, 0.0 if not n else blocked / n)
    prior = blocked / n
    rows = lexical_features(rows.filter(share_below(F.col("url"), bounded_share(n, max_labelled)))).withColumn("_fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    rows = stored(rows, "url-labelled")
    rate = lambda hits, seen: [((hits + 10 * prior) / (seen + 10)).alias("suffix_blocked"), F.log1p(seen).alias("suffix_seen")]
    by_fold = stored(rows.groupBy("_suffix", "_fold").agg(F.sum("label").alias("hits"), F.count("*").alias("seen")), "url-suffixes")
    sums = by_fold.groupBy("_suffix").agg(F.sum("hits").alias("all_hits"), F.sum("seen").alias("all_seen"))
    suffixes = stored(sums.select("_suffix", *rate(F.col("all_hits"), F.col("all_seen"))), "url-suffixes")
    others = by_fold.join(sums, "_suffix").select("_suffix", "_fold", *rate(F.col("all_hits") - F.col("hits"), F.col("all_seen") - F.col("seen")))
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows.join(others, ["_suffix", "_fold"]))
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1)
    return UrlModel(gbt.fit(train.select("_features", "label")), suffixes, prior)


def url_verdicts(df: DataFrame, model: UrlModel | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
                 url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` to every row.

    The longest rule decides; where none fits, the model blocks at ``p_block >= threshold``. Without a
    model, one is fitted on the URLs that the rules decide. Columns of these names are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "p_block")]
    rows = df.select(F.struct(*keep).alias("row"), F.col(url).alias("url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        model = fit_url_model(rows.filter(F.col("hit").isNotNull()).select("url", (F.col("hit.verdict") == "block").cast("int").alias("label")))
    by_model = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return model.score(rows).select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_model).alias("verdict"), "p_block")
