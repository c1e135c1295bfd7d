"""Following logs: segments that a stream brings, and folders whose files grow, rotate and go.

Whatever a micro-batch writes lies under its number and is written over when the batch is repeated, so a lost driver or
executor costs a repetition and no row is there twice. What a batch has to know of those before it - line numbers so far,
identities of files - is a small table of its own, written last: it commits the batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window

from tidelog.operators.timeline import common
from tidelog.sources.extraction import read_store, write_load
from tidelog.sources.lines import PREFIX, match_contents, split_totals
from tidelog.sources.ranges import head_hashes, listed, read_from
from tidelog.sources.scratch import stored


def stream_lines(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New lines of new files: ``file_id``, ``path``, ``line_no`` (null), ``raw``; ``number_segments`` numbers them.

    A producer that leaves an unfinished last line in a segment breaks it there.
    """
    text = spark.readStream.options(lineSep="\n", pathGlobFilter=glob, maxFilesPerTrigger=per_trigger, recursiveFileLookup="true").text(folder)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file_id"), F.col("_metadata.file_path").alias("path"), F.lit(None).cast("bigint").alias("line_no"),
        F.regexp_replace("value", "\r\\z", "").alias("raw"), F.col("_metadata.file_block_start").alias("block_start"), (F.octet_length("value") + 1).cast("bigint").alias("size"))


def _last(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The table that the last batch before ``batch`` left, if any."""
    try:
        before = spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < batch)
    except AnalysisException:
        return None
    last = before.agg(F.max("batch")).first()[0]
    return None if last is None else before.filter(F.col("batch") == last).drop("batch")


def number_batch(batch: DataFrame, number: int, path: str, log: Column) -> None:
    """Number a micro-batch of ``stream_lines`` on from the totals of its logs and write it under ``path``.

    ``log`` tells of a row which log its segment is of; the segments of a log follow each other by batch, then by
    path. ``lines/batch=<n>`` has ``log``, ``path``, ``line_no``, ``byte_offset`` and ``raw``, ``totals/batch=<n>`` the lines and
    bytes of every log so far.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("seq", F.monotonically_increasing_id())
    log_of = stored(rows.select("path", log.cast("string").alias("log")).distinct(), "segments")
    splits = split_totals(rows)
    segments = splits.groupBy("path").agg(F.sum("lines").alias("n"), F.sum("bytes").alias("b")).join(log_of, "path")
    along = Window.partitionBy("log").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per segment
    before = _last(spark, f"{path}/totals", number)
    if before is None:
        before = spark.createDataFrame([], "log string, lines long, bytes long")
    so_far = before.select("log", F.col("lines").alias("_l"), F.col("bytes").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    segments = stored(segments.join(so_far, "log", "left").select(
        "path", "log", "n", "b", (zero(F.col("_l")) + zero(F.sum("n").over(along))).alias("_first"), (zero(F.col("_b")) + zero(F.sum("b").over(along))).alias("_from")), "segments")
    inside = F.sum("size").over(Window.partitionBy("path", "block_start").orderBy("seq")) - F.col("size")
    placed = rows.join(splits, ["path", "block_start"]).withColumns({"_n": F.col("lines_before") + F.col("seq") - F.col("least"), "_o": F.col("bytes_before") + inside})
    out = placed.join(segments, "path").select("log", "path", (F.col("_first") + F.col("_n")).alias("line_no"), (F.col("_from") + F.col("_o")).alias("byte_offset"), "raw")
    out.write.mode("overwrite").parquet(f"{path}/lines/batch={number}")
    mine = segments.groupBy("log").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    totals = before.join(mine, "log", "full").select("log", (zero(F.col("lines")) + zero(F.col("n"))).alias("lines"), (zero(F.col("bytes")) + zero(F.col("b"))).alias("bytes"))
    stored(totals, "totals").write.mode("overwrite").parquet(f"{path}/totals/batch={number}")


def number_segments(lines: DataFrame, path: str, checkpoint: str, log: Column):
    """Number the lines of a stream of segments as if each log's segments were one file; returns the started query."""
    put = lambda batch, number: number_batch(batch, number, path, log)
    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_segments(spark: SparkSession, path: str) -> DataFrame:
    """What ``number_segments`` has written and committed."""
    lines = spark.read.option("basePath", f"{path}/lines").parquet(f"{path}/lines/batch=*")
    done = spark.read.option("basePath", f"{path}/totals").parquet(f"{path}/totals/batch=*").agg(F.max("batch").alias("_done"))
    return lines.join(F.broadcast(done), F.col("batch") <= F.col("_done")).drop("_done")  # one row


def stream_parse_filter(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """Parse and filter only what is new; stateless."""
    events = parse(lines)
    return events.filter(predicate(events))


def stream_histogram(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window of time and severity; late rows up to ``late`` behind still count."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n")).select(F.unix_millis("window.start").alias("bucket_from_ms"), "severity", "n")


def put_timeline(batch: DataFrame, number: int, path: str) -> None:
    """Write a micro-batch of events under its number, by day; a repeated batch writes over itself."""
    rows = common(batch).filter(F.col("ts_ms").isNotNull()).withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")


def stream_timeline(events: DataFrame, path: str, checkpoint: str):
    """Events of a stream in a table by batch and day, to be ordered when read; returns the started query."""
    put = lambda batch, number: put_timeline(batch, number, path)
    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rotation(saved: DataFrame, contents: DataFrame) -> DataFrame:
    """What to do with each known file of a table: ``idle``, ``append`` or ``reload``."""
    return match_contents(saved, contents).select("path", action(F.col("match")).alias("action"))


def action(match: Column) -> Column:
    return F.when(match == "Identical", "idle").when(match == "Grown", "append").otherwise("reload")


KNOWN = "path string, size long, prefix_length long, prefix_sha256 string, next_line long, next_byte long"


def look(spark: SparkSession, folder: str, table: str, parse: Callable[[DataFrame], DataFrame], number: int, **options: str) -> DataFrame:
    """Bring the events of ``table`` to what the files of ``folder`` hold now; returns the ``action`` per ``path``.

    The registry under ``table`` has every file's size, identity and the line that comes next. A file with the same
    identity is left alone, of a grown one the bytes from its next line on are read, a new or rotated one (smaller, or
    with another beginning) is read from its first byte and replaces what was there, and the rows of one that is gone
    go. An unfinished last line counts and is read again when it has grown. ``number`` grows from look to look; a look
    that is repeated writes what it wrote before.
    """
    registry = f"{table}/_registry"
    known = _last(spark, registry, number)
    known = known if known is not None else spark.createDataFrame([], KNOWN)
    now = listed(spark, folder, **{"recursiveFileLookup": "true"} | options).withColumnRenamed("size", "now")
    both = stored(now.join(known, "path", "full"), "look")
    head = head_hashes(both.filter("now is not null").select("path", F.col("now").alias("size"), F.least("now", F.lit(PREFIX)).alias("length"))).select("path", F.col("length").alias("new_length"), F.col("sha256").alias("new_sha256"))
    again = head_hashes(both.filter("now >= prefix_length").select("path", F.col("now").alias("size"), F.col("prefix_length").alias("length"))).select("path", F.col("sha256").alias("_sha256"))
    same = F.coalesce((F.col("_sha256") == F.col("prefix_sha256")) & (F.col("now") >= F.col("size")), F.lit(False))
    what = F.when(F.col("now").isNull(), "drop").when(F.col("size").isNull(), "load").when(~same, "reload").when(F.col("now") > F.col("size"), "append").otherwise("idle")
    told = both.join(head, "path", "left").join(again, "path", "left").withColumn("action", what)
    kept = F.col("action") == "append"
    told = stored(told.withColumns({"from_byte": F.when(kept, F.col("next_byte")).otherwise(0), "first_line": F.when(kept, F.col("next_line")).otherwise(0)}), "look")
    moved = told.filter(F.col("action") != "idle")
    wanted = moved.filter(F.col("action") != "drop").select("path", "from_byte", "first_line", F.col("now").alias("size"))
    lines = stored(read_from(wanted), "tail")
    first = moved.select(F.xxhash64("path").alias("file_id"), "first_line")
    write_load(parse(lines.drop("terminated", "size")), table, number, first, anew=True)  # what a look that broke off left may be of other files
    # where the next look goes on: after the last line, or at it if it has no end
    end = F.max_by(F.struct("line_no", "byte_offset", F.col("size").alias("bytes"), "terminated"), "line_no")
    last = lines.groupBy("path").agg(end.alias("e")).select("path", "e.*")
    idle, ended = F.col("action") == "idle", F.col("terminated")
    next_line = F.when(ended, F.col("line_no") + 1).when(~ended, F.col("line_no")).when(idle, F.col("next_line")).otherwise(F.col("first_line"))
    next_byte = F.when(ended, F.col("byte_offset") + F.col("bytes")).when(~ended, F.col("byte_offset")).when(idle, F.col("next_byte")).otherwise(F.col("from_byte"))
    done = told.filter(F.col("action") != "drop").join(last, "path", "left")
    done = done.select("path", F.col("now").alias("size"), F.col("new_length").alias("prefix_length"), F.col("new_sha256").alias("prefix_sha256"), next_line.alias("next_line"), next_byte.alias("next_byte"))
    stored(done, "registry").write.mode("overwrite").parquet(f"{registry}/batch={number}")
    return told.select("path", "action")


def followed(spark: SparkSession, table: str) -> DataFrame:
    """The events that the looks have left."""
    return read_store(spark, table)


def splice(head: DataFrame, tail: DataFrame, first_new: DataFrame) -> DataFrame:
    """Old rows below each file's first new line, and the new rows; equals a full recomputation."""
    kept = head.join(first_new.select("file_id", "first_new_line"), "file_id", "left").filter(F.coalesce(F.col("line_no") < F.col("first_new_line"), F.lit(True))).drop("first_new_line")
    return kept.unionByName(tail)
