"""Places of regular-expression matches in texts, as native columns (code points, end exclusive).

A pattern's matches and the text between them give the places: ``split`` and ``regexp_extract_all`` walk the
same leftmost, non-overlapping matches. Patterns must not match the empty string. A text with very many matches costs
little more than in proportion: running values are gathered in parts of PART, and spans are looked up in sorted
lists by halving. What a lambda reads for every element is bound by ``let`` outside of it: the optimizer may move the
expression of a column that is mentioned once into the lambda, where it would run for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

SPAN = "array<struct<start:bigint,stop:bigint,kind:int,value:string>>"
#: Values that a fold gathers before it puts them away: a fold that appends copies what it has so far.
PART = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def running(n: Column, first: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The values that ``step(last value, index)`` gives for the indices 0 to n - 1; ``kind`` is their type."""
    def part(state: Column, c: Column) -> Column:
        inside = F.sequence(c * PART, F.least(c * PART + PART, n) - 1)
        grow = lambda s, i: let(step(s["last"], i), lambda v: F.struct(v.alias("last"), F.concat(s["part"], F.array(v)).alias("part")))
        start = F.struct(state["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("part"))
        return let(F.aggregate(inside, start, grow), lambda s: F.struct(s["last"].alias("last"), F.concat(state["parts"], F.array(s["part"])).alias("parts")))

    start = F.struct(first.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("parts"))
    parts = F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))
    return F.when(n > 0, F.flatten(F.aggregate(parts, start, part, lambda s: s["parts"]))).otherwise(F.array().cast(f"array<{kind}>"))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add ``_m_<name>``, the matches, ``_g_<name>``, the texts before, between and after them, and ``_e_<name>``,
    where the matches end."""
    df = df.withColumns({f"_m_{n}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    df = df.withColumns({f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(text, p, -1)) for n, p in patterns.items()})

    def ends(name: str) -> Column:
        m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")
        sizes = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda own, before: F.length(before) + F.length(own))
        return let(F.when(F.size(m) > 0, sizes).otherwise(F.array().cast("array<int>")), lambda n: running(F.size(n), F.lit(0), lambda at, i: at + n[i], "bigint"))

    return df.withColumns({f"_e_{n}": ends(n) for n in patterns})


def folded(name: str, item: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """One struct per match, in text order, made by ``item(start, stop, match, (before, after))``."""
    both = F.struct(F.col(f"_g_{name}").alias("g"), F.col(f"_e_{name}").alias("ends"))
    around = lambda x, i: (x["g"][i], x["g"][i + 1])
    return let(both, lambda x: F.transform(F.col(f"_m_{name}"), lambda m, i: item((x["ends"][i] - F.length(m)).cast("bigint"), x["ends"][i], m, around(x, i))))


def spans(name: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """The spans of the matches that ``keep`` takes."""
    every = folded(name, lambda a, b, m, _: F.struct(a.alias("start"), b.alias("stop"), F.lit(kind).alias("kind"), m.alias("value")))
    return F.filter(every, lambda s: keep(s["value"]))


def joined(arrays: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of spans, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(arrays, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def starting_before(sorted_spans: Column, place: Column) -> Column:
    """How many spans of a list sorted by ``start`` start before a place, by halving."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(sorted_spans[mid]["start"] < place, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    n = F.size(sorted_spans)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1.0))).cast("int"))
    return F.when(n > 0, F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])).otherwise(0)


def touches(span: Column, sorted_spans: Column) -> Column:
    """Whether a span overlaps one of a sorted list of spans that don't overlap each other."""
    return let(starting_before(sorted_spans, span["stop"]), lambda k: F.when(k > 0, sorted_spans[k - 1]["stop"] > span["start"]).otherwise(False))
