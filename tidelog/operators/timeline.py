"""Events of several files and formats in one order of time."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidelog.functions import severity as sev
from tidelog.operators.parse import message_column

COLUMNS = ["file_id", "path", "line_no", "ts_ms", "severity", "message"]


def common(events: DataFrame) -> DataFrame:
    """What all formats share: key, instant, severity and message."""
    return events.select("file_id", "path", "line_no", "ts_ms", "severity", F.col(f"`{message_column(events)}`").alias("message"))


def union(tables: list[DataFrame]) -> DataFrame:
    every = common(tables[0])
    for t in tables[1:]:
        every = every.unionByName(common(t))
    return every


def timeline_merge(tables: list[DataFrame], descending: bool = False) -> DataFrame:
    """Rows that have an instant, by instant, file and line (range-partitioned), or the reverse."""
    rows = union(tables).filter(F.col("ts_ms").isNotNull())
    keys = ("ts_ms", "file_id", "line_no")
    return rows.orderBy(*[F.col(k).desc() if descending else F.col(k) for k in keys])


def timeline_dropped(tables: list[DataFrame]) -> DataFrame:
    return union(tables).groupBy("file_id").agg(F.count_if(F.col("ts_ms").isNull()).alias("dropped"))


def timeline_status(events: DataFrame, has_time: bool = True, monotonic: bool = False) -> DataFrame:
    """Per file ``Ready``, or why it can't be merged."""
    reason = F.lit("time since boot can't be merged") if monotonic else F.lit("no timestamps") if not has_time else F.when(F.count("ts_ms") == 0, "no parsable time").otherwise("Ready")
    return events.groupBy("file_id").agg(reason.alias("status"))


def timeline_dedupe(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"])


def timeline_filter(tables: list[DataFrame], predicate: Callable[[DataFrame], Column]) -> list[DataFrame]:
    """The same filter on every table; ``predicate`` builds it per table, unknown fields being true."""
    return [t.filter(predicate(t)) for t in tables]


def timeline_view(rows: DataFrame) -> DataFrame:
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("time"), sev.display_name(F.col("severity")).alias("severity"), "message")


def first_row_at_time(rows: DataFrame, ms: int) -> DataFrame:
    return rows.filter(F.col("ts_ms") >= ms).orderBy("ts_ms", "file_id", "line_no").limit(1)


def first_rows_at_times(rows: DataFrame, times: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """For each ``t_ms`` of a table the first row at or after it.

    Rows and times are cut into buckets of time: within its bucket a window looks ahead, beyond it the first
    row of the next bucket that has one. Only one row per bucket meets in one place.
    """
    key = F.struct("ts_ms", "file_id", "line_no")
    own = rows.select(F.floor(F.col("ts_ms") / bucket_ms).alias("b"), F.col("ts_ms").alias("at"), key.alias("row"), F.lit(None).cast("bigint").alias("t_ms"))
    asked = times.select(F.floor(F.col("t_ms") / bucket_ms).alias("b"), F.col("t_ms").alias("at"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), "t_ms").distinct()
    firsts = own.groupBy("b").agg(F.min("row").alias("first"))
    later = firsts.unionByName(asked.select("b", F.lit(None).cast(firsts.schema["first"].dataType).alias("first")).distinct()).groupBy("b").agg(F.min("first").alias("first"))
    # backward, over frames that grow by a row: frames that shrink are gone through anew for every row
    ahead = later.select("b", F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    inside = Window.partitionBy("b").orderBy(F.desc("at"), F.col("t_ms").isNull().desc(), F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(asked).withColumn("hit", F.last("row", ignorenulls=True).over(inside)).filter("t_ms is not null")
    return found.join(ahead, "b").withColumn("r", F.coalesce("hit", "next")).select("t_ms", "r.ts_ms", "r.file_id", "r.line_no")
