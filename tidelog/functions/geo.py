"""Coordinates in text: decimal degrees or degrees, minutes and seconds; null where there are none in range."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from tidelog.functions.severity import number_of
from tidelog.functions.timecol import found, groups, let

# Patterns of coordinates (case-insensitive).
TIMESTAMP = r"(?i)^\[?\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[+-]\d{2}:?\d{2}|Z)?\]?\s*"
KEY_VALUE = r"(?i)latitude[=:]\s*([-+]?\d+\.?\d*)\s*°.*longitude[=:]\s*([-+]?\d+\.?\d*)\s*°"
PAIR = r"(?i)([-+]?\d+\.?\d*)\s*°?\s*([NS])?\s*[,\s]+\s*([-+]?\d+\.?\d*)\s*°?\s*([EW])?"
LABELED = r"(?i)(?:lat(?:itude)?[=:]\s*)?([-+]?\d+\.?\d*)\s*°?\s*([NS])?\s*[,\s]+\s*(?:lon(?:g(?:itude)?)?[=:]\s*)?([-+]?\d+\.?\d*)\s*°?\s*([EW])?"
DMS = r"""(?i)(\d+)\s*°\s*(\d+)\s*'\s*(\d+(?:\.\d+)?)\s*"?\s*([NS])\s*[,\s]+\s*(\d+)\s*°\s*(\d+)\s*'\s*(\d+(?:\.\d+)?)\s*"?\s*([EW])"""


def _number(text: Column, pattern: str, group: int) -> Column:
    return number_of(F.regexp_extract(text, pattern, group), "double")


def _point(lat: Column, lon: Column) -> Column:
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def _signed(text: Column, pattern: str) -> Column:
    side = lambda i, letter: F.when(F.upper(F.regexp_extract(text, pattern, i)) == letter, -1).otherwise(1)
    return _point(_number(text, pattern, 1) * side(2, "S"), _number(text, pattern, 3) * side(4, "W"))


def geo_decimal(text: Column) -> Column:
    """Key-value, plain or labelled pair; the first that matches decides, in range or not."""
    has = lambda p: F.rlike(text, F.lit(p))
    return F.when(has(KEY_VALUE), _point(_number(text, KEY_VALUE, 1), _number(text, KEY_VALUE, 2))).when(has(PAIR), _signed(text, PAIR)).when(has(LABELED), _signed(text, LABELED))


def geo_dms(text: Column) -> Column:
    """Degrees, minutes and seconds with hemispheres, by one run of the pattern."""
    return let(groups(text, DMS, range(1, 9)), _dms_point)


def _dms_point(parts: Column) -> Column:
    d = {i: number_of(F.get(parts, F.lit(i)), "double") for i in (1, 2, 3, 5, 6, 7)}
    good = found(parts, 8) & (d[1] <= 90) & (d[2] < 60) & (d[3] < 60) & (d[5] <= 180) & (d[6] < 60) & (d[7] < 60)
    side = lambda i, letter: F.when(F.upper(F.get(parts, F.lit(i))) == letter, -1).otherwise(1)
    lat, lon = (d[1] + d[2] / 60.0 + d[3] / 3600.0) * side(4, "S"), (d[5] + d[6] / 60.0 + d[7] / 3600.0) * side(8, "W")
    return F.when(F.coalesce(good, F.lit(False)), _point(lat, lon))


def coordinates(raw: Column) -> Column:
    """``lat`` and ``lon`` of a line, its leading timestamp apart."""
    text = F.regexp_replace(raw, TIMESTAMP, "")
    return F.coalesce(geo_decimal(text), geo_dms(text))
