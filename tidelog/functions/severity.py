"""Severities: 0..6 as TINYINT, their names, and the mapping of level names and syslog priorities."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Severities in order, and what level names and syslog priorities stand for.
NAMES = ("none", "verbose", "debug", "info", "warning", "error", "fatal")
ALIASES = {
    "trace": 1, "debug": 2, "info": 3, "notice": 3, "warn": 4, "warning": 4, "error": 5, "err": 5,
    "fatal": 6, "critical": 6, "crit": 6, "panic": 6,
}
PRIORITIES = {0: 6, 1: 6, 2: 6, 3: 5, 4: 4, 5: 3, 6: 3, 7: 2}


def number_of(text: Column, kind: str) -> Column:
    """``text.try_cast(kind)``; what doesn't begin like a number isn't tried, as a cast that fails throws and catches
    within Spark, which takes longer than the rest of a row."""
    tried = F.filter(F.array(text), lambda t: F.rlike(t, F.lit(r"^[\x00-\x20\x7f]*[+-]?[.0-9]")))  # the text is computed once
    return F.get(tried, F.lit(0)).try_cast(kind)


def lookup(key: Column, values: dict, default=None) -> Column:
    """The value of a key in a small constant table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], F.lit(default)) if default is not None else table[key]


def from_name(name: Column) -> Column:
    return lookup(F.lower(name), ALIASES, 0).cast("tinyint")


def from_priority(text: Column) -> Column:
    """Severity of a syslog priority given as text; 0 where it is none."""
    return F.coalesce(lookup(number_of(text, "int"), PRIORITIES), F.lit(0)).cast("tinyint")


def severity_map(text: Column) -> Column:
    """Level text to severity: by name, else by syslog priority."""
    named = from_name(text)
    return F.when(named != 0, named).otherwise(from_priority(text)).cast("tinyint")


def display_name(severity: Column) -> Column:
    """``Error`` for 5; empty for 0."""
    return F.when(severity > 0, F.initcap(F.element_at(F.array(*map(F.lit, NAMES)), severity.cast("int") + 1))).otherwise("")


def number(name: str) -> int:
    """0..6 of a severity or level name; ValueError if it is none."""
    key = name.lower()
    if key in NAMES:
        return NAMES.index(key)
    if key == "unknown":
        return 0
    if key in ALIASES:
        return ALIASES[key]
    raise ValueError(f"no severity: {name}")
