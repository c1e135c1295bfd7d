"""Predicates over raw lines and typed columns: two-valued, so that ``~`` selects exactly the other rows.

A missing or invalid value matches no comparison, ``!=`` included. Text folds the case of A-Z by default.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

import pyspark.sql.functions as F
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession

from tidelog.functions.severity import number

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPANS_MS = {"day": 86_400_000, "minute": 60_000, "second": 1000, "100ms": 100, "10ms": 10, "1ms": 1}


def sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def told(predicate: Column) -> Column:
    """``sure`` of a cheap comparison, as a conjunction whose first part a scan understands."""
    return predicate & predicate.isNotNull()


def fold(text: Column) -> Column:
    """Lower-case as a needle's case is folded: A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def filter_text(raw: Column, needle: str, case_sensitive: bool = False) -> Column:
    """The line holds the needle; an empty needle matches all. Non-ASCII needles fold by Unicode."""
    if not needle:
        return F.lit(True)
    if case_sensitive:
        return sure(F.contains(raw, F.lit(needle)))
    folded = fold if needle.isascii() else F.lower
    return sure(F.contains(folded(raw), F.lit(needle.lower())))


def pattern_error(pattern: str) -> str | None:
    """Why a pattern doesn't compile in the engine's own dialect; None where it does."""
    session = SparkSession.active()
    try:
        session._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def filter_regex(raw: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """The line matches somewhere; a pattern that doesn't compile matches nothing."""
    if pattern_error(pattern) is not None:
        return F.lit(False)
    return sure(F.rlike(raw, F.lit(("(?d)" if case_sensitive else "(?di)") + pattern)))


def filter_invert(predicate: Column, needle: str) -> Column:
    """The other lines; an empty needle is not inverted."""
    return ~predicate if needle else predicate


def line_filter(raw: Column, needle: str = "", regex: bool = False, case_sensitive: bool = False, invert: bool = False, extra: Column | None = None) -> Column:
    """Text or regex filter, inverted or not, and an extra predicate on top."""
    found = filter_regex(raw, needle, case_sensitive) if regex and needle else filter_text(raw, needle, case_sensitive)
    found = filter_invert(found, needle) if invert else found
    return found if extra is None else found & sure(extra)


def field_contains(value: Column, needle: str, case_sensitive: bool = False) -> Column:
    return filter_text(value, needle, case_sensitive)


def field_wildcard(value: Column, glob: str, case_sensitive: bool = False) -> Column:
    """Whole-value glob; ``*`` and ``?`` don't cross a slash."""
    pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
    return sure(F.rlike(value, F.lit(("(?s)" if case_sensitive else "(?is)") + f"^{pattern}$")))


def field_cmp(value: Column, op: str, other: str, case_sensitive: bool = False) -> Column:
    """``= != < <= > >=`` of text; both sides fold unless case matters. Order is by bytes."""
    left, right = (value, F.lit(other)) if case_sensitive else (F.lower(value), F.lit(other.lower()))
    return sure(_compare(left, op, right))


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def int_cmp(value: Column, op: str, other: int) -> Column:
    return told(_compare(value.cast("bigint"), "=" if op == ":" else op, F.lit(other)))


def severity_cmp(severity: Column, op: str, name: str, level_text: Column | None = None) -> Column:
    """Ordered comparison with a level name; an unknown name compares the level's text."""
    try:
        return told(_compare(severity.cast("int"), "=" if op == ":" else op, F.lit(number(name))))
    except ValueError:
        if level_text is None:
            raise
        return field_contains(level_text, name) if op == ":" else field_cmp(level_text, op, name)


def in_range(value: Column, op: str, low: int, high: int) -> Column:
    """Comparison with the half-open [low, high); written so that file statistics can prune."""
    return told({"=": (value >= low) & (value < high), "!=": (value < low) | (value >= high), "<": value < low, "<=": value < high, ">": value >= high, ">=": value >= low}[op])


def epoch_ms(t: date | datetime) -> int:
    if not isinstance(t, datetime):
        t = datetime(t.year, t.month, t.day)
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def time_cmp(ms: Column, op: str, t: date | datetime, granularity: str = "second") -> Column:
    """Comparison with a time literal, which stands for the span of its granularity."""
    low = epoch_ms(t)
    return in_range(ms, op, low, low + SPANS_MS[granularity])


def time_of_day_cmp(ms: Column, op: str, low_ms: int, high_ms: int, zone: str = "UTC") -> Column:
    """Comparison of the zone's wall clock with a range of ms of a day."""
    local = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))
    return in_range(F.pmod(local, F.lit(86_400_000)), op, low_ms, high_ms)


def uptime_cmp(ms: Column, op: str, seconds: str) -> Column:
    """Comparison with seconds since boot as text, e.g. ``"1.5"``, which stands for its last digit's span."""
    if not isinstance(seconds, str) or not re.fullmatch(r"\d+(\.\d{1,3})?", seconds):
        raise ValueError(f"an uptime is compared with seconds, not {seconds!r}")
    whole, _, fraction = seconds.partition(".")
    low = int(whole) * 1000 + int(fraction.ljust(3, "0") or 0)
    return in_range(ms, op, low, low + 10 ** (3 - len(fraction)))


def level_tag_filter(severity: Column, tag: Column, severities: list[int], tags: list[str]) -> Column:
    found = severity.cast("int").isin(severities)
    return sure(found & tag.isin(tags)) if tags else sure(found)


def bbox_filter(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return sure(lat.between(south, north) & lon.between(west, east))


def resolve_field(df: DataFrame, name: str) -> str | None:
    """The column of that name, ignoring case and spaces; the first wins."""
    plain = lambda x: x.replace(" ", "").lower()
    return next((c for c in df.columns if plain(c) == plain(name)), None)


def unknown_field_true(df: DataFrame, name: str, build) -> Column:
    """``build(column)``, or true where the table lacks the field."""
    found = resolve_field(df, name)
    return F.lit(True) if found is None else build(F.col(f"`{found}`"))


def include_exclude(df: DataFrame, name: str, value: object, op: str) -> Column:
    """The predicate that a cell stands for: equal, different, at or after, at or before its value."""
    column = F.col(f"`{resolve_field(df, name)}`")
    if isinstance(value, bool) or not isinstance(value, (int, str, datetime)):
        raise TypeError(f"no cell value: {value!r}")
    if isinstance(value, datetime):
        return time_cmp(column, op, value, "1ms")
    return int_cmp(column, op, value) if isinstance(value, int) else field_cmp(column, op, value, case_sensitive=True)


def highlight_rules(raw: Column, rules: list[dict]) -> Column:
    """Colour of the first enabled rule (text or regex, at most 32) that matches; null if none."""
    found = [F.when(line_filter(raw, r["pattern"], r.get("regex", False), r.get("case_sensitive", False)), F.lit(r["color"])) for r in rules if r.get("enabled", True) and r["pattern"]]
    return F.coalesce(*found[:32]) if found else F.lit(None).cast("string")


def row_color(highlight: Column, severity: Column, colors: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in colors.items() for x in pair])
    return F.coalesce(highlight, table[severity.cast("int")])
