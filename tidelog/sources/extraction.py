"""Kept extractions: the parsed columns of a set of files, written once and read by every field query.

Layout of a store: ``load=<n>/day=<day>/part-*.parquet``. A load holds what one extraction made, partitioned by the day of
the instant (rows without one are in a partition of their own) and sorted by instant within a file, so a time range
prunes by partition and then by file and row-group statistics, and a field query reads its own columns only. Load 0
is the extraction of whole files; every tail of grown files is a load of its own, with the first line of each file that
it replaces. A load is written under a name of its own and renamed when it stands: a failed or repeated one leaves no
half and no second copy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from tidelog.functions.predicates import SPANS_MS, epoch_ms, time_cmp
from tidelog.sources.scratch import scratch_root

#: Rows of a table with a row per file that may be sent to every task.
SENT_FILES = 1_000_000


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def published(spark: SparkSession, made: str, path: str) -> None:
    """Rename what was ``made`` to ``path``; where another one stands by then, that one stays."""
    fs, where = _hadoop(spark, path)
    fs.mkdirs(where.getParent())
    if fs.exists(where) or not fs.rename(_hadoop(spark, made)[1], where):
        fs.delete(_hadoop(spark, made)[1], True)


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))


def write_load(events: DataFrame, store: str, load: int, first_lines: DataFrame | None = None, anew: bool = False) -> None:
    """Write ``events``, without the lines themselves, as a load; ``first_lines`` (file_id, first_line) says from which lines on
    it replaces others. One that stands is kept, or made ``anew``."""
    spark = events.sparkSession
    if anew:
        removed(spark, f"{store}/load={load}")
        removed(spark, f"{store}/_replaced/load={load}")
    if not exists(spark, f"{store}/load={load}"):
        made = f"{store}/_making-{uuid.uuid4().hex}"
        rows = with_day(events.drop("raw", "byte_offset")).repartition("day", F.pmod(F.xxhash64("file_id", "line_no"), F.lit(8))).sortWithinPartitions("day", "ts_ms")
        rows.write.option("compression", "zstd").partitionBy("day").parquet(made)
        if first_lines is not None:  # before the load itself, so that no row is ever read twice
            replaced = f"{store}/_making-{uuid.uuid4().hex}"
            first_lines.select("file_id", "first_line").write.parquet(replaced)
            published(spark, replaced, f"{store}/_replaced/load={load}")
        published(spark, made, f"{store}/load={load}")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The events of all loads, without the rows that a later load replaces, and their ``day``."""
    events = spark.read.option("basePath", store).parquet(f"{store}/load=*")
    try:
        replaced = spark.read.option("basePath", f"{store}/_replaced").parquet(f"{store}/_replaced/load=*")
    except AnalysisException:
        return events.drop("load")
    later = replaced.select(F.col("file_id").alias("_f"), F.col("first_line").alias("_l"), F.col("load").alias("_load"))
    later = F.broadcast(later) if later.count() <= SENT_FILES else later
    stale = (F.col("file_id") == F.col("_f")) & (F.col("load") < F.col("_load")) & (F.col("line_no") >= F.col("_l"))
    return events.join(later, stale, "left_anti").drop("load")


def source_key(spark: SparkSession, paths: list[str], more: str = "") -> str:
    """A name for files as they are now, from the sizes and times of the listing."""
    seen = []
    for path in paths:
        fs, where = _hadoop(spark, path)
        files = [fs.getFileStatus(where)] if fs.getFileStatus(where).isFile() else fs.listStatus(where)
        seen += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha256(repr((seen, more)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, paths: list[str], name: str, extract: Callable[[], DataFrame]) -> DataFrame:
    """The kept extraction ``name`` of the files ``paths``; it is made where there is none of the files as they are now."""
    store = f"{scratch_root(spark)}/extraction-{name}-{source_key(spark, paths, name)}"
    if not exists(spark, f"{store}/load=0"):
        write_load(extract(), store, 0)
    return read_store(spark, store)


def within(op: str, low: int, high: int) -> Column:
    """What a comparison of ``ts_ms`` with [low, high) implies for ``day``."""
    day = lambda ms: F.lit((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)).date())
    first, last = day(low), day(high - 1)
    value = F.col("day")
    return {"=": (value >= first) & (value <= last), "<": value <= first, "<=": value <= last, ">": value >= last, ">=": value >= first, "!=": value.isNotNull()}[op]


def at_time(events: DataFrame, op: str, t: date | datetime, granularity: str = "second") -> DataFrame:
    """The events of a store whose instant compares so with a time literal; prunes days, then files and row groups."""
    low = epoch_ms(t)
    return events.filter(within(op, low, low + SPANS_MS[granularity])).filter(time_cmp(F.col("ts_ms"), op, t, granularity))
