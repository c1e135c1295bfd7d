"""Search over many files, and points in lines."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from tidelog.functions.geo import coordinates
from tidelog.functions.predicates import bbox_filter
from tidelog.operators.parse import once
from tidelog.sources.lines import line_numbers, read_lines
from tidelog.sources.ranges import rejects

#: Matches kept per file, bytes of an excerpt, bytes of a file that are searched for NUL.
MAX_MATCHES, EXCERPT, BINARY_BYTES = 1000, 400, 1 << 24


def binary_files(lines: DataFrame) -> DataFrame:
    """``file_id`` of files with a NUL in their first bytes."""
    near = F.coalesce("byte_offset", F.lit(0)) < BINARY_BYTES
    return lines.filter(near & F.contains("raw", F.lit("\0"))).select("file_id").distinct()


def grep(lines: DataFrame, match: Column, max_matches: int = MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(matches, files): matching lines with excerpts, at most ``max_matches`` a file by line; and per file the
    matches kept, whether there are more, and whether it was skipped as binary."""
    binary = binary_files(lines)
    hits = lines.join(binary, "file_id", "left_anti").filter(match)
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))).filter(F.col("_n") <= max_matches + 1)
    excerpt = F.make_valid_utf8(F.substring(F.encode("raw", "UTF-8"), 1, EXCERPT).cast("string"))  # a character cut in two is U+FFFD
    excerpt = F.when(F.octet_length("raw") <= EXCERPT, F.col("raw")).otherwise(excerpt)
    matches = ranked.filter(F.col("_n") <= max_matches).select("file_id", "path", "line_no", "byte_offset", excerpt.alias("excerpt"))
    counts = ranked.groupBy("file_id").agg(F.least(F.count("*"), F.lit(max_matches)).alias("matches"), (F.max("_n") > max_matches).alias("truncated"))
    files = lines.select("file_id").distinct().join(counts, "file_id", "left").join(binary.withColumn("skipped_binary", F.lit(True)), "file_id", "left")
    return matches, files.select("file_id", F.coalesce("matches", F.lit(0)).alias("matches"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("truncated", "skipped_binary")])


def grep_counts(files: DataFrame) -> DataFrame:
    """Total matches and files with any."""
    return files.agg(F.sum("matches").alias("matches"), F.count_if(F.col("matches") > 0).alias("files_with_matches"))


def grep_errors(files: DataFrame) -> DataFrame:
    """``path`` and ``error`` of the listed files (``path``, ``size``) that a search can't read to their end: a gzip stream
    that is corrupt or cut, a file that is gone or may not be opened."""
    return rejects(files)


def read_sound(spark: SparkSession, files: DataFrame, rejected: DataFrame, **options: str) -> DataFrame:
    """Numbered lines of the listed files that are not rejected; the names go to the reader."""
    sound = [r["path"] for r in files.join(rejected, "path", "left_anti").select("path").collect()]  # names, as for any read
    return line_numbers(read_lines(spark, sound, **options))


def geo_points(lines: DataFrame) -> DataFrame:
    """``file_id``, ``line_no``, ``lat``, ``lon`` of lines that hold coordinates."""
    return once(lines, ["file_id", "line_no"], {"_p": coordinates(F.col("raw"))}).filter("_p is not null").select("file_id", "line_no", "_p.lat", "_p.lon")


def geo_visible(points: DataFrame, rows: DataFrame, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points on visible rows and inside (south, west, north, east)."""
    shown = points.join(rows.select("file_id", "line_no"), ["file_id", "line_no"], "left_semi")
    return shown if area is None else shown.filter(bbox_filter(F.col("lat"), F.col("lon"), *area))
