"""Personal data: fixed base patterns, and candidate spans judged by gradient-boosted trees.

High-recall generators propose overlapping spans of each kind, from looser patterns than the base ones: any short run of
signs between digits, words and brackets for the signs of an address, and each number under every kind that its digits
allow. Boosted
trees see the format of a span (digits, separators, checksum) and its context (characters and cue words around).
What they add are spans that the base patterns miss, so they must not learn those patterns back: every confirmed span
is shown as it is and disguised (``disguised``: other separators, words for signs, no plus), in the same context, and so
is its form with content that is none (``spoilt``), with label 0. Candidates that provably are none (a part over 255, a
failing checksum, too few digits, a date, a number where a domain ends) have label 0 as well. Other candidates are
unlabelled and weigh UNLABELLED as much as one of label 0. Per kind, the threshold is calibrated to the wanted precision on held-out labelled examples, confirmed
ones in disguise only; candidates at or above it, clear of base spans and of better candidates, are added.
All work is DataFrame expressions and Spark ML on the JVM.

Defined results: a null or empty text has no spans; rows with equal or null ids are scanned one by one; where the
candidates hold one label only, nothing is added. Columns other than the key and the text are not used.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from tidelog.llm.common import bounded_share, share_below, stored
from tidelog.llm.spans import folded, joined, let, overlaps, spans, starting_before, touches, with_matches

#: Kinds in the order of the digests.
KINDS = ("email", "ip", "card", "phone")
#: Fixed base patterns, written so that no run of characters is walked twice: a match starts where its run of
#: characters does or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = (r"(?:\x20?(?:" + sign + r"|[(\[{<]\x20?(?i:" + name + r")\x20?[)\]}>])\x20?)" for sign, name in (("@", "at"), (r"\.", "dot")))
_PART, _GROUP = r"[\w-]{1,63}", "[0-9A-Fa-f]{1,4}"
#: Generators: name -> pattern. Names, labels and runs are bounded (64, 63 and 8 labels, 22 digits): what is longer is
#: no address and no number.
GENERATORS = {
    # name, sign or word for @, labels parted by signs or words for dots; or all words
    "at": rf"(?<![\w.%+'-])[\w.%+'-]{{1,64}}+(?:{_AT}{_PART}(?:(?:{_DOT}|\x20(?i:dot)\x20){_PART}){{1,8}}|\x20(?i:at)\x20{_PART}(?:\x20(?i:dot)\x20{_PART}){{1,8}})",
    # four numbers around dots, with other signs or words for them; eight groups with colons, or fewer around ::
    "quad": rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:[^0-9A-Za-z\n]{{0,2}}\.[^0-9A-Za-z\n]{{0,2}}|\x20?[(\[{{<]?(?i:dot)[)\]}}>]?\x20?)[0-9]{{1,3}}){{3}}"
            rf"|(?<![0-9A-Za-z:])(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])(?:{_GROUP}:){{2,7}}{_GROUP}(?![0-9A-Za-z:])",
    # digits with up to three signs between them
    "digits": r"(?<![0-9+])[+(]?[0-9](?:[^\p{L}\p{N}\n]{0,3}[0-9]){8,21}(?![0-9])",
}
CUES = r"(?i)(tel|phone|call|fax|mobile|card|visa|iban|account|mail|contact|address|ip|host|server)\W{0,3}$"
#: Content in general (whether it could be of the kind, how its digits are grouped) and context; nothing tells one sign that
#: parts it from another, or an address in words from one in signs.
FEATURES = ("kind", "sound", "groups", "longest_group", "signs", "plus", "luhn", "left_blank", "left_word", "right_blank", "right_word", "cue")
#: The precision that thresholds are calibrated to, and the weight of an example without a label.
PRECISION, UNLABELLED = 0.98, 0.05


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at least one digit passes the checksum."""
    backward = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(backward, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def is_card(match: Column) -> Column:
    digits = digits_of(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def is_ip(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p).between(1, 3), p.try_cast("int") <= 255).otherwise(False))


def is_phone(match: Column) -> Column:
    return F.length(digits_of(match)).between(10, 15)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``row``, validated ``base`` spans and ``candidates`` with the text around them.

    ``same`` tells whether a base span of the candidate's kind overlaps it, ``taken`` whether any does.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = with_matches(rows, "_text", PATTERNS | GENERATORS)
    own = [F.col(f"_b{k}") for k in range(len(KINDS))]
    checks = (lambda m: F.lit(True), is_ip, is_card, is_phone)
    found = found.withColumns({f"_b{k}": spans(name, k, keep) for k, (name, keep) in enumerate(zip(KINDS, checks, strict=True))})
    proposed = F.concat(*[F.flatten(folded(name, _candidates(kinds))) for name, kinds in (("at", only(0)), ("quad", only(1)), ("digits", number_kinds))])
    told = let(F.struct(*own), lambda bases: F.transform(proposed, lambda c: let(F.array(*[touches(c, bases[f"_b{k}"]) for k in range(len(KINDS))]), lambda t: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
        t[c["kind"]].alias("same"), F.array_contains(t, F.lit(True)).alias("taken")))))
    return found.select(F.col("_key").alias(key), F.monotonically_increasing_id().alias("row"), F.concat(*own).alias("base"), told.alias("candidates"))


def only(kind: int):
    return lambda _: F.array(F.lit(kind))


def number_kinds(match: Column) -> Column:
    """All kinds that a number's digits allow; where none does, the nearer one, as an example of what is none."""
    n = F.length(digits_of(match))
    fits = F.array_compact(F.array(F.when(n.between(14, 19), 2), F.when(n.between(10, 15), 3)))
    return F.when(F.size(fits) > 0, fits).otherwise(F.array(F.when(n < 13, 3).otherwise(2)))


def _candidates(kinds):
    return lambda a, b, m, around: F.transform(kinds(m), lambda kind: F.struct(
        a.alias("start"), b.alias("stop"), kind.alias("kind"), m.alias("value"), F.right(around[0], F.lit(24)).alias("before"), F.left(around[1], F.lit(8)).alias("after")))


def plain_ip(value: Column) -> Column:
    """A number with dots, whatever stands for them; with colons, as it is."""
    return F.when(F.contains(value, F.lit(":")), value).otherwise(F.regexp_replace(value, "[^0-9]+", "."))


def is_any_ip(value: Column) -> Column:
    """Whether a candidate is a sound IPv4 or IPv6 address."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    short = F.regexp_count(value, F.lit("::"))
    six = F.rlike(value, F.lit("[0-9]")) & (((short == 0) & (groups == 8)) | ((short == 1) & groups.between(1, 7)))
    return F.when(F.contains(value, F.lit(":")), six).otherwise(is_ip(plain_ip(value)))


#: A number that begins with a date.
DATE = r"^(19|20)[0-9]{2}[^0-9]{0,2}(0[1-9]|1[0-2])[^0-9]{0,2}(0[1-9]|[12][0-9]|3[01])(?=[^0-9]|[0-9]{4,6}$)"


def provably_none(kind: Column, value: Column) -> Column:
    """Candidates whose content rules the kind out, whatever their format."""
    n = F.length(digits_of(value))
    domain_end = F.regexp_extract(value, r"([\w-]+)[\])}>]?$", 1)
    return F.when(kind == 0, ~F.rlike(domain_end, F.lit("^(?:[^\\W0-9_]{2,}|xn--.+)$"))).when(
        kind == 1, ~is_any_ip(value)).otherwise(F.rlike(value, F.lit(DATE)) | F.when(kind == 2, ~is_card(value)).otherwise(~n.between(10, 15)))


def disguised(kind: Column, value: Column) -> Column:
    """The same content in a format that the base patterns miss; which one follows from a hash of the value."""
    way = F.pmod(F.xxhash64(value), F.lit(3))
    digits = digits_of(value)
    mail = [F.regexp_replace(F.regexp_replace(value, r"\.(?=[^@]*$)", dot), "@", at) for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."))]
    card = [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", F.lit(f"$1{sign}")) for sign in (".", "/", " - ")]
    local = lambda form: F.regexp_replace(digits, "^[0-9]*([0-9]{3})([0-9]{3})([0-9]{4})$", form)
    phone = [F.regexp_replace(value, r"^\+", ""), local("($1) $2-$3"), local("$1.$2.$3")]
    one_of = lambda ways: F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])
    return F.when(kind == 0, one_of(mail)).when(kind == 1, F.regexp_replace(value, r"\.", F.when(way == 0, "(.)").otherwise(" . "))).when(kind == 2, one_of(card)).otherwise(one_of(phone))


def spoilt(kind: Column, value: Column) -> Column:
    """The same form with content that is none of the kind: a domain that ends in digits, a part over 255, a failing checksum,
    too few or too many digits or a date; which one follows from a hash of the value."""
    way = F.pmod(F.xxhash64(value, F.lit(5)), F.lit(3))
    few, many = F.left(value, F.lit(9)), F.concat(value, F.lit(" 4455667"))
    when = F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64(value), F.lit(2_000_000_000))), "yyyy-MM-dd HH:mm:ss")
    card = F.concat(F.left(value, F.length(value) - 1), F.translate(F.right(value, F.lit(1)), "0123456789", "1234567890"))
    part = F.concat((F.lit(256) + F.pmod(F.xxhash64(value), F.lit(700))).cast("string"), F.regexp_replace(value, "^[0-9]+", ""))
    return F.when(kind == 0, F.regexp_replace(value, "[^.]+$", "12")).when(kind == 1, part).when(kind == 2, card).when(way == 0, few).when(way == 1, many).otherwise(when)


def with_features(spans_of: DataFrame) -> DataFrame:
    """Add the columns of ``FEATURES`` to rows of one candidate each, in ``c``."""
    kind, value, digits = F.col("c.kind"), F.col("c.value"), digits_of(F.col("c.value"))
    before, after = F.right("c.before", F.lit(1)), F.left("c.after", F.lit(1))
    number = lambda v: F.when(kind >= 2, v).otherwise(0)  # noqa: E731  an address has no groups of digits to go by
    found = {
        "kind": kind, "sound": ~provably_none(kind, value), "groups": number(F.regexp_count(value, F.lit("[0-9]+"))), "signs": number(F.least(F.regexp_count(value, F.lit("[^0-9A-Za-z]+")), F.lit(8))),
        "longest_group": number(F.array_max(F.transform(F.split(value, "[^0-9]+"), F.length))), "plus": F.startswith(value, F.lit("+")), "luhn": number(F.when(F.length(digits) > 0, luhn(digits)).otherwise(False).cast("int")),
        "left_blank": (before == "") | F.rlike(before, F.lit(r"\s")), "left_word": F.rlike(before, F.lit(r"\w")),
        "right_blank": (after == "") | F.rlike(after, F.lit(r"\s")), "right_word": F.rlike(after, F.lit(r"\w")), "cue": F.rlike("c.before", F.lit(CUES)),
    }
    return spans_of.withColumns({k: F.coalesce(v.cast("double"), F.lit(-1.0)) for k, v in found.items()})


class PiiModel:
    """Trees and the least score that is redacted, by kind number (kinds that are missing add nothing)."""

    def __init__(self, trees: GBTClassificationModel | None, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def scored(self, candidates: DataFrame) -> DataFrame:
        keep = candidates.columns
        out = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(with_features(candidates)))
        return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def candidates_of(found: DataFrame) -> DataFrame:
    """A row per candidate."""
    return found.select("row", F.explode("candidates").alias("c"))


def examples(candidates: DataFrame) -> DataFrame:
    """``c``, ``label``, ``weight`` and ``hidden`` (in disguise) of candidates ``c``.

    A confirmed one is shown as it is and in disguise, and spoilt in both forms with label 0; one that provably is none as
    it is and in disguise; unlabelled ones have label 0 and weigh less.
    """
    kind, value = F.col("c.kind"), F.col("c.value")
    none = provably_none(kind, value) & ~F.col("c.taken")
    shown = lambda v, label, weight, hidden: F.struct(v.alias("value"), F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.lit(hidden).alias("hidden"))
    bad = spoilt(kind, value)
    confirmed = F.array(shown(value, 1.0, 1.0, False), shown(disguised(kind, value), 1.0, 1.0, True), shown(bad, 0.0, 1.0, False), shown(disguised(kind, bad), 0.0, 1.0, True))
    ruled_out = F.array(shown(value, 0.0, 1.0, False), shown(disguised(kind, value), 0.0, 1.0, True))
    variants = F.when(F.col("c.same"), confirmed).when(none, ruled_out).otherwise(F.array(shown(value, 0.0, UNLABELLED, False)))
    told = candidates.filter(F.col("c.same") | ~F.col("c.taken")).select("c", F.explode(variants).alias("v"))
    # a disguise may make good what was spoilt: it takes a number's last digits
    told = told.filter((F.col("v.label") == 1) | (F.col("v.weight") < 1) | provably_none(kind, F.col("v.value")))
    return told.select(F.col("c").withField("value", F.col("v.value")).alias("c"), "v.label", "v.weight", "v.hidden", F.xxhash64("c.value", "c.before", "c.after").alias("key"))


def fit_pii_model(labelled: DataFrame, max_candidates: int | None = None, precision: float = PRECISION, trees: int = 15, depth: int = 5) -> PiiModel:
    """Fit on all ``examples`` (or, where wanted, on about ``max_candidates``); a fifth of the contents calibrates."""
    n, positive = labelled.agg(F.count("label"), F.sum("label")).first()
    if not n or not 0 < positive < n:
        return PiiModel(None, {})
    picked = labelled if max_candidates is None else labelled.filter(share_below(F.col("key"), bounded_share(n, max_candidates)))
    picked = stored(with_features(picked).withColumn("part", F.pmod(F.col("key"), F.lit(5))), "pii-sample")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(picked)
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, minWeightFractionPerNode=0.005, seed=3, checkpointInterval=-1)
    model = gbt.fit(rows.filter("part > 0").select("_features", "label", "weight"))
    judged = model.transform(rows.filter("part = 0 and weight = 1 and (hidden or label = 0)")).select(F.col("c.kind").alias("k"), "label", "weight", F.floor(vector_to_array("probability")[1] * 200).alias("bin"))
    bins = judged.groupBy("k", "bin").agg(F.sum("weight").alias("n"), F.sum("label").alias("hits")).collect()  # at most 4 x 201 rows
    thresholds = {}
    for kind in range(len(KINDS)):
        total = hits = 0
        for r in sorted((r for r in bins if r["k"] == kind), key=lambda r: -r["bin"]):
            total, hits = total + r["n"], hits + r["hits"]
            if hits and hits >= precision * total:
                thresholds[kind] = r["bin"] / 200
    return PiiModel(model, thresholds)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", model: PiiModel | None = None) -> DataFrame:
    """Per row ``key``, ``base`` and ``added`` spans (start, stop, kind number, value)."""
    found = stored(scanned(docs, key, text), "pii-spans")
    candidates = candidates_of(found)
    model = model or fit_pii_model(stored(examples(candidates), "pii-examples"))
    if model.trees is None or not model.thresholds:
        return found.select(key, "base", F.filter("base", lambda b: F.lit(False)).alias("added"))
    least = F.create_map(*[F.lit(x) for k, t in model.thresholds.items() for x in (k, t)])
    good = model.scored(candidates.filter(~F.col("c.taken"))).filter(F.col("p") >= least[F.col("c.kind")])
    mine = good.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.stop").alias("stop"), "p", F.col("c.value").alias("value")))).alias("all"))
    better = lambda a, b: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["kind"] < a["kind"]))))
    near = lambda every, a, longest: let(F.struct(starting_before(every, a["start"] - longest).alias("lo"), starting_before(every, a["stop"]).alias("hi")),
                                         lambda w: F.slice(every, w["lo"] + 1, w["hi"] - w["lo"]))
    best = let(F.array_max(F.transform("all", lambda s: s["stop"] - s["start"])), lambda longest: F.filter("all", lambda a: ~F.exists(near(F.col("all"), a, longest), lambda b: overlaps(a, b) & better(a, b))))
    mine = mine.select("row", F.transform(best, lambda s: F.struct(s["start"], s["stop"], s["kind"], s["value"])).alias("added"))
    none = F.filter("base", lambda b: F.lit(False))
    return found.join(mine, "row", "left").select(key, "base", F.coalesce("added", none).alias("added"))


def pii_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(key, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"))


def redacted(found: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the text with every span replaced by its kind in brackets; keys must be unique."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    rows = texts.select(key, text).join(found, key)
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["stop"] <= s["at"], s).otherwise(F.struct(
        x["stop"].alias("at"), F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int")), names[x["kind"]]).alias("out")))
    done = F.aggregate(ordered, first, step)
    return rows.withColumn("_r", done).select(key, F.concat("_r.out", F.substring(F.col(text), (F.col("_r.at") + 1).cast("int"), F.length(text))).alias(text))
