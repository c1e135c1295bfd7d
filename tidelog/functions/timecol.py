"""Text to UTC epoch milliseconds, as native columns; text that is no time of its format is null.

Milliseconds are truncated. Wall times without an offset are read in ``zone``; an explicit offset wins. Year-less
times take their year from a reference instant (a file's modification time): the year before, if their month is
later than the reference's. In a daylight-saving gap the result is Spark's ``to_utc_timestamp``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.functions.severity import number_of

_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})"
_OFFSET = r"(?:\s*(Z|z|[+-]\d{2}(?::?\d{2})?))?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


@dataclass(frozen=True)
class Shape:
    """A pattern and the part (y, mon, mo, d, h, mi, s, f, off) that each of its groups holds."""

    pattern: str
    parts: tuple[str, ...]


# Named time formats in the order in which detection prefers them, and the epoch ranges.
SHAPES = {
    "iso8601": Shape(r"^(\d{4})-(\d{2})-(\d{2})(?:[Tt\s](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?" + _OFFSET + ")?$", ("y", "mo", "d", "h", "mi", "s", "f", "off")),
    "clf": Shape(r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):" + _CLOCK + _OFFSET + "$", ("d", "mon", "y", "h", "mi", "s", "off")),
    "logcat": Shape(r"^(\d{2})-(\d{2})\s+" + _CLOCK + r"(?:[.,](\d+))?$", ("mo", "d", "h", "mi", "s", "f")),
    "klog": Shape(r"^(\d{2})(\d{2})\s+" + _CLOCK + r"(?:[.,](\d+))?$", ("mo", "d", "h", "mi", "s", "f")),
    "snort": Shape(r"^(\d{2})/(\d{2})-" + _CLOCK + r"(?:[.,](\d+))?$", ("mo", "d", "h", "mi", "s", "f")),
    "rfc3164": Shape(r"^([A-Za-z]{3})\s+(\d{1,2})\s+" + _CLOCK + r"(?:[.,](\d+))?$", ("mon", "d", "h", "mi", "s", "f")),
}
LADDER = (*SHAPES, "epoch-us", "epoch-ms", "epoch-s", "uptime")
EPOCH = {"epoch-us": (10**14, 10**17, 6), "epoch-ms": (10**11, 10**14, 3), "epoch-s": (10**8, 10**11, 0)}
_TOKENS = {
    "yyyy": (r"(\d{4})", "y"), "MMM": ("([A-Za-z]{3})", "mon"), "MM": (r"(\d{2})", "mo"), "M": (r"(\d{1,2})", "mo"), "dd": (r"(\d{2})", "d"),
    "d": (r"(\d{1,2})", "d"), "HH": (r"(\d{1,2})", "h"), "H": (r"(\d{1,2})", "h"), "mm": (r"(\d{2})", "mi"), "ss": (r"(\d{2})", "s"),
}


def custom_shape(fmt: str) -> Shape:
    """The shape of a pattern of yyyy, MMM, MM, M, dd, d, HH, H, mm, ss, z...; blanks match any white space."""
    pattern, parts, at = "", [], 0
    while at < len(fmt):
        z = re.match("z+", fmt[at:])
        token = next((t for t in _TOKENS if fmt.startswith(t, at)), None)
        if z:
            pattern, at = pattern + r"(\d+)", at + z.end()
            parts.append("f")
        elif token:
            piece, part = _TOKENS[token]
            pattern, at = pattern + piece, at + len(token)
            parts.append(part)
        else:
            pattern, at = pattern + (r"\s+" if fmt[at] == " " else re.escape(fmt[at])), at + 1
    if parts and parts[-1] == "s":
        pattern, parts = pattern + r"(?:[.,](\d+))?", [*parts, "f"]
    return Shape(f"^{pattern}{_OFFSET}$", (*parts, "off"))


def infer_year(month: Column, reference: Column) -> Column:
    """The year of a year-less month, seen from a reference timestamp."""
    return F.when(month > F.month(reference), F.year(reference) - 1).otherwise(F.year(reference))


def assume_zone(naive: Column, zone: str) -> Column:
    """A wall-clock timestamp (held as if in UTC) read in ``zone``."""
    return F.to_utc_timestamp(naive, zone)


def _offset_ms(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    minutes = number_of(F.left(digits, F.lit(2)), "int") * 60 + F.coalesce(number_of(F.substring(digits, 3, 2), "int"), F.lit(0))
    return F.when(F.upper(text) == "Z", F.lit(0)).otherwise(F.when(F.startswith(text, F.lit("-")), -minutes).otherwise(minutes)) * 60000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def groups(text: Column, pattern: str, numbers: Sequence[int]) -> Column:
    """Where a pattern is found in a text without line feeds, an array of an empty text and these groups (0: always
    empty; a group that takes no part is empty), by one run of the pattern. Else another array, or null."""
    template = "".join("\n" + (f"${n}" if n else "") for n in numbers)
    whole = f"(?d)(?s:^.*?)(?:{pattern})(?s:.*)\\z"
    return F.when(~F.contains(text, F.lit("\n")), F.split(F.regexp_replace(text, F.lit(whole), F.lit(template)), "\n", -1))


def found(parts: Column, n: int) -> Column:
    """Whether ``groups`` found its pattern, of n groups."""
    return F.coalesce(F.size(parts) == n + 1, F.lit(False))


def _calendar(text: Column, shape: Shape, zone: str, reference: Column) -> Column:
    return let(groups(text, shape.pattern, range(1, len(shape.parts) + 1)), lambda parts: _instant(parts, shape, zone, reference))


def _instant(parts: Column, shape: Shape, zone: str, reference: Column) -> Column:
    part = {name: F.get(parts, F.lit(i + 1)) for i, name in enumerate(shape.parts)}
    number = lambda name, default: F.coalesce(number_of(part[name], "int"), F.lit(default)) if name in part else F.lit(default)
    place = F.instr(F.lit(_MONTHS), F.lower(part["mon"])) if "mon" in part else None
    month = F.when((place % 3) == 1, ((place + 2) / 3).cast("int")) if place is not None else number("mo", 1)
    year = number("y", 1970) if "y" in part else infer_year(month, reference)
    second = number("s", 0)
    naive = F.try_make_timestamp(year, month, number("d", 1), number("h", 0), number("mi", 0), F.least(second, F.lit(59)), F.lit("UTC"))
    ms = number_of(F.rpad(F.left(part["f"], F.lit(3)), 3, "0"), "int") if "f" in part else F.lit(0)
    more = F.coalesce(ms, F.lit(0)) + F.when(second == 60, 1000).otherwise(0)
    offset = part.get("off", F.lit(""))
    instant = F.when(offset != "", F.unix_millis(naive) - _offset_ms(offset)).otherwise(F.unix_millis(assume_zone(naive, zone)))
    return F.when(found(parts, len(shape.parts)) & (second <= 60), (instant + more).cast("bigint"))


def _scaled(text: Column, kind: str) -> Column:
    if kind == "uptime":
        return F.when(F.rlike(text, F.lit(r"^\d+(\.\d+)?$")), F.floor(text.try_cast("decimal(38,9)") * 1000).cast("bigint"))
    low, high, digits = EPOCH[kind]
    value = number_of(F.regexp_extract(text, r"^(\d{1,18})(?:\.\d+)?$", 1), "bigint")
    if kind == "epoch-s":
        ms = F.floor(F.when(F.rlike(text, F.lit(r"^\d{1,18}(\.\d+)?$")), text).try_cast("decimal(38,9)") * 1000)
    else:
        ms = F.floor(value / 10 ** (digits - 3))
    return F.when((value >= low) & (value < high), ms.cast("bigint"))


def normalize_time(text: Column, fmt: str, zone: str = "UTC", reference: Column | None = None) -> Column:
    """Epoch ms of ``text`` in a named format, an epoch or uptime kind, or a custom pattern; "" detects by row."""
    text = F.trim(text)
    reference = F.current_timestamp() if reference is None else reference
    if not fmt:
        return let(text, lambda t: F.coalesce(*[normalize_time(t, kind, zone, reference) for kind in LADDER if kind != "uptime"]))
    if fmt in EPOCH or fmt == "uptime":
        return _scaled(text, fmt)
    return _calendar(text, SHAPES.get(fmt) or custom_shape(fmt), zone, reference)


def detect_time_format(lines: DataFrame, column: str, zone: str = "UTC", reference: Column | None = None) -> DataFrame:
    """Per file the format that most samples of ``column`` parse in; ties by the ladder.

    Samples: the first 256 non-empty values of the first 2048 lines. Whole numbers are no evidence of uptime.
    """
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    sample = lines.filter((F.col("line_no") < 2048) & (F.col(column) != "")).withColumn("_n", first).filter("_n <= 256")
    value = F.col(column)
    hits = {k: normalize_time(value, k, zone, reference).isNotNull() & (F.contains(value, F.lit(".")) if k == "uptime" else F.lit(True)) for k in LADDER}
    counted = sample.groupBy("file_id").agg(*[F.count_if(h).alias(k) for k, h in hits.items()])
    pairs = F.array(*[F.struct(F.col(f"`{k}`").alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(LADDER)])
    best = counted.select("file_id", F.array_max(pairs).alias("b"))
    return best.select("file_id", F.when(F.col("b.n") > 0, F.col("b.kind")).alias("time_format"), F.col("b.n").alias("n"))
