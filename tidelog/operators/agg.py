"""Histograms over time, spans and counts."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.functions.timecol import detect_time_format
from tidelog.operators.parse import time_column

BUCKETS = 512


def _counted(df: DataFrame, ms: str, severity: str | None) -> DataFrame:
    """Rows per instant and severity: what bounds and buckets are both made of, so that the source is read once."""
    lane = F.col(severity).cast("int") if severity else F.lit(0)
    return df.filter(F.col(ms).isNotNull()).groupBy(F.col(ms).alias("ms"), lane.alias("severity")).agg(F.count("*").alias("n")).filter("n > 0")


def _binned(counts: DataFrame, bounds: DataFrame, n: int, lanes: int) -> DataFrame:
    """Counts per bucket and severity, zeroes included; ``bounds`` is one row (from_ms, to_ms, width)."""
    span = F.broadcast(bounds)  # one row
    placed = counts.join(span, F.col("ms").between(F.col("from_ms"), F.col("to_ms")))
    counted = placed.groupBy(F.floor((F.col("ms") - F.col("from_ms")) / F.col("width")).cast("int").alias("bucket"), "severity").agg(F.sum("n").alias("n"))
    every = counts.sparkSession.range(n * lanes).select(F.floor(F.col("id") / lanes).cast("int").alias("bucket"), (F.col("id") % lanes).cast("int").alias("severity"))
    grid = every.join(span, F.col("from_ms") <= F.col("to_ms"))
    start = F.col("from_ms") + F.col("bucket") * F.col("width")
    return grid.join(counted, ["bucket", "severity"], "left").select("bucket", start.cast("bigint").alias("bucket_from_ms"), F.col("severity").cast("tinyint").alias("severity"), F.coalesce("n", F.lit(0)).alias("n"))


def _width(low: Column, high: Column, n: int) -> Column:
    return F.greatest(F.lit(1), F.floor((high - low) / n) + 1)


def histogram_auto(df: DataFrame, n: int = BUCKETS, ms: str = "ts_ms", severity: str | None = "severity") -> DataFrame:
    """From the first to the last instant, in ``n`` buckets by severity; without any instant there are no rows."""
    counts = _counted(df, ms, severity)
    bounds = counts.agg(F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms")).withColumn("width", _width(F.col("from_ms"), F.col("to_ms"), n))
    return _binned(counts, bounds, n, 7 if severity else 1)


def histogram_range(df: DataFrame, from_ms: int, to_ms: int, n: int = BUCKETS, ms: str = "ts_ms", severity: str | None = "severity") -> DataFrame:
    """Over [from_ms, to_ms]; rows outside are not counted. 0 and 0 mean automatic."""
    if from_ms == to_ms == 0:
        return histogram_auto(df, n, ms, severity)
    bounds = df.sparkSession.range(1).select(F.lit(from_ms).alias("from_ms"), F.lit(to_ms).alias("to_ms")).withColumn("width", _width(F.col("from_ms"), F.col("to_ms"), n))
    return _binned(_counted(df.filter(F.col(ms).between(from_ms, to_ms)), ms, severity), bounds, n, 7 if severity else 1)


def histogram_multi(tables: list[DataFrame], n: int = BUCKETS) -> DataFrame:
    """Of several tables over their shared span."""
    every = tables[0].select("ts_ms", "severity")
    for t in tables[1:]:
        every = every.unionByName(t.select("ts_ms", "severity"))
    return histogram_auto(every, n)


def histogram_summary(df: DataFrame, n: int = BUCKETS, ms: str = "ts_ms") -> DataFrame:
    """One row: span, bucket width and how many rows have no instant."""
    out = df.agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count_if(F.col(ms).isNull()).alias("invalid_rows"))
    return out.withColumn("width", _width(F.col("min_ms"), F.col("max_ms"), n))


def time_span(df: DataFrame, sample: int | None = None) -> DataFrame:
    """First and last instant per file, and whether its times are ``monotonic``, counted from a start and of no date.

    That follows from the format of the time column, or, where the format is told by file, from what a file's first
    values are. With ``sample``, spans are those of that many lines at either end.
    """
    column = time_column(df)
    fmt = df.schema[column].metadata.get("timeFormat", "") if column else None
    kinds = detect_time_format(df.select("file_id", "line_no", F.col(f"`{column}`").alias("_t")), "_t") if fmt == "" else None
    if sample is not None:
        ends = df.groupBy("file_id").agg(F.max("line_no").alias("_last"))
        df = df.join(ends, "file_id").filter((F.col("line_no") < sample) | (F.col("line_no") > F.col("_last") - sample))
    spans = df.groupBy("file_id").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    if kinds is None:
        return spans.withColumn("monotonic", F.lit(fmt == "uptime"))
    own = kinds.select("file_id", (F.col("time_format") == "uptime").alias("monotonic"))
    return spans.join(own, "file_id", "left").withColumn("monotonic", F.coalesce("monotonic", F.lit(False)))


def valid_time_count(df: DataFrame) -> DataFrame:
    return df.groupBy("file_id").agg(F.count("ts_ms").alias("valid"))


def parse_quality(df: DataFrame) -> DataFrame:
    """Per file and format: lines, parsed lines and lines of each severity."""
    lanes = [F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in range(7)]
    return df.groupBy("file_id", "format").agg(F.count("*").alias("lines"), F.count_if("ok").alias("ok_lines"), *lanes)


def distinct_tags(df: DataFrame, tag: str = "Tag") -> DataFrame:
    """Sorted distinct tags of parsed rows."""
    return df.filter(F.col("ok") & (F.col(tag) != "")).select(F.col(tag).alias("tag")).distinct().orderBy("tag")
