"""Text files as numbered raw lines, folders, and file identities.

``raw_lines``: file_id BIGINT, path STRING, line_no BIGINT (from 0), byte_offset BIGINT, raw STRING. Only ``\\n`` parts
lines; one ``\\r`` before it is trimmed, a lone one is content; an unterminated last line counts. Gzip files are read
by their suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, SparkSession, Window

from tidelog.sources.ranges import head_bytes, head_hashes, listed
from tidelog.sources.scratch import stored

#: Bytes hashed for a file's identity.
PREFIX = 65536
#: Notes beside logs are no logs.
SIDECAR = ".notes.json"


def read_lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """``path``, ``block_start``, ``seq`` (order in the split), ``size`` (bytes with the end) and ``raw``."""
    text = spark.read.options(lineSep="\n", **options).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"), (F.octet_length("value") + 1).cast("bigint").alias("size"),
        F.regexp_replace("value", "\r\\z", "").alias("raw"))


#: Rows of a table with a row per split that may be sent to every task.
SENT_SPLITS = 1_000_000


def split_totals(lines: DataFrame, log: Column | None = None) -> DataFrame:
    """Per split ``path``, ``block_start``, its least ``seq``, its lines and those before it in the file, and the same of
    bytes: a small table that is written once. The files of a ``log`` (of the path; else each file) follow each other by path."""
    totals = stored(lines.groupBy("path", "block_start").agg(F.min("seq").alias("least"), F.count("*").alias("lines"), F.sum("size").alias("bytes")), "splits")
    along = Window.partitionBy(F.col("path") if log is None else log).orderBy("path", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    totals = totals.withColumns({"lines_before": before("lines"), "bytes_before": before("bytes")})
    return F.broadcast(totals) if totals.count() <= SENT_SPLITS else totals


def _numbered(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """``lines`` with their number in the split, ``_n``, and the split's totals.

    Rows of a split follow each other in one task, so a row's number there is ``seq`` less the split's least one.
    A read that cuts the files otherwise than the totals were made raises an error.
    """
    n = F.col("seq") - F.col("least")
    other = F.raise_error(F.lit("the files were cut otherwise when they were read again")).cast("bigint")
    return lines.join(totals, ["path", "block_start"], "left").withColumn("_n", F.when(n.between(0, F.col("lines") - 1), n).otherwise(other))


def _summed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_before``, the bytes before a line in its split; rows of a split follow each other in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column("path"), batch.column("block_start")
            size = batch.column("size").to_numpy(zero_copy_only=False)
            other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(other) + 1])
            before = np.cumsum(size) - size
            before -= np.repeat(before[first], np.diff(first, append=len(size)))
            if (path[0].as_py(), start[0].as_py()) == split:
                before[: first[1] if len(first) > 1 else None] += so_far
            split, so_far = (path[-1].as_py(), start[-1].as_py()), before[-1] + size[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "_before"])

    return lines.mapInArrow(rows, T.StructType([*lines.schema, T.StructField("_before", T.LongType())]))


def line_numbers(lines: DataFrame, log: Column | None = None, offsets: bool = False) -> DataFrame:
    """Number lines in place: no text is shuffled or sorted; ``byte_offset`` is null unless ``offsets`` are wanted.

    A table with a row per split, sent to all tasks, tells how many lines come before. A gzip file is one split. Of a
    ``log`` that is cut into files (a column of the path), numbers and offsets go on from file to file.
    """
    totals = split_totals(lines, log)
    found = _numbered(_summed(lines) if offsets else lines, totals)
    offset = F.col("bytes_before") + F.col("_before") if offsets else F.lit(None)
    return found.select(
        F.xxhash64("path" if log is None else log).alias("file_id"), "path", (F.col("lines_before") + F.col("_n")).cast("bigint").alias("line_no"), offset.cast("bigint").alias("byte_offset"), "raw")


def line_offsets(lines: DataFrame, log: Column | None = None) -> DataFrame:
    """``file_id``, ``line_no`` and ``byte_offset`` of every line; nothing is shuffled."""
    return line_numbers(lines.withColumn("raw", F.lit("")), log, offsets=True).select("file_id", "line_no", "byte_offset")


def folder_lines(spark: SparkSession, folder: str, globs: tuple[str, ...] = ("*",)) -> DataFrame:
    """Lines, not numbered, of all files below a folder whose name fits a glob; sidecar files are left out."""
    found = read_lines(spark, folder, recursiveFileLookup="true", pathGlobFilter="{" + ",".join(globs) + "}")
    return found.filter(~F.endswith("path", F.lit(SIDECAR)))


def read_folder(spark: SparkSession, folder: str, globs: tuple[str, ...] = ("*",), log: Column | None = None, offsets: bool = False) -> DataFrame:
    """Numbered lines of ``folder_lines``."""
    return line_numbers(folder_lines(spark, folder, globs), log, offsets)


def split_texts(table: DataFrame, file_id: str, text: str, path: str = "table") -> DataFrame:
    """Texts of a table as files, a row each: ``raw_lines`` by the same rules."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n$", "")
    lines = table.select(F.col(file_id).cast("bigint").alias("file_id"), F.when(F.coalesce(F.col(text), F.lit("")) != "", F.split(whole, "\n", -1)).alias("l"))
    numbered = lines.select("file_id", F.posexplode("l").alias("n", "value"))
    return numbered.select("file_id", F.concat(F.lit(path + "/"), F.col("file_id").cast("string")).alias("path"), F.col("n").cast("bigint").alias("line_no"), F.lit(None).cast("bigint").alias("byte_offset"), F.regexp_replace("value", "\r\\z", "").alias("raw"))


def match_contents(saved: DataFrame, contents: DataFrame) -> DataFrame:
    """``match_identity`` of files that a table holds as ``path``, ``content``."""
    now = saved.join(contents.select("path", "content"), "path", "left")
    size = F.octet_length("content")
    return now.select("path", verdict(size, F.sha2(F.substring(F.col("content"), F.lit(1), F.col("prefix_length")), 256)).alias("match"))


def verdict(size: Column, sha256: Column) -> Column:
    """Identical, Grown or Mismatch, of a file's size and the hash over the saved prefix; null: the file is gone."""
    other = (sha256 != F.col("prefix_sha256")) | (size < F.col("size"))
    return F.when(F.coalesce(other, F.lit(True)), "Mismatch").when(size > F.col("size"), "Grown").otherwise("Identical")


def file_identity(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """``path``, ``size``, ``prefix_length`` and ``prefix_sha256`` of files of any size; their first PREFIX bytes are read."""
    files = listed(spark, paths, **options).withColumn("length", F.least("size", F.lit(PREFIX)))
    return head_hashes(files).select("path", "size", F.col("length").cast("int").alias("prefix_length"), F.col("sha256").alias("prefix_sha256"))


def match_identity(saved: DataFrame, now: DataFrame) -> DataFrame:
    """``path`` and ``match``: Identical, Grown or Mismatch, of saved identities against files as listed (``path``, ``size``).

    The current file is hashed over the saved prefix length, no more is read of it; one that shrank, or is gone,
    mismatches.
    """
    long_enough = saved.select("path", F.col("prefix_length").cast("bigint").alias("length")).join(now.select("path", F.col("size").alias("now")), "path").filter("now >= length")
    hashes = head_hashes(long_enough.withColumnRenamed("now", "size"))
    found = saved.join(hashes.select("path", F.col("size").alias("_size"), "sha256"), "path", "left")
    return found.select("path", verdict(F.col("_size"), F.col("sha256")).alias("match"))


def log_heads(files: DataFrame) -> DataFrame:
    """Per ``log`` its ``size`` and the ``sha256`` of its first ``length`` bytes, of the files (``log``, ``path``, ``size``,
    ``length``) that it is cut into, in the order of their paths."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy("log").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    taken = F.greatest(F.least("size", F.col("length") - before), F.lit(0))
    heads = head_bytes(files.select("log", "path", "size", taken.alias("length")).filter((F.col("length") > 0) | (F.col("size") == 0)))
    content = F.aggregate(F.array_sort(F.collect_list(F.struct("path", "head"))), F.lit(b""), lambda all_, x: F.concat(all_, x["head"]))  # PREFIX bytes in all
    return files.groupBy("log").agg(F.sum("size").alias("size")).join(heads.groupBy("log").agg(F.sha2(content, 256).alias("sha256")), "log")


def log_identity(files: DataFrame) -> DataFrame:
    """``file_identity`` of logs that are cut into files (``log``, ``path``, ``size``), by ``log``."""
    found = log_heads(files.withColumn("length", F.lit(PREFIX).cast("bigint")))
    return found.select("log", "size", F.least("size", F.lit(PREFIX)).cast("int").alias("prefix_length"), F.col("sha256").alias("prefix_sha256"))


def match_logs(saved: DataFrame, now: DataFrame) -> DataFrame:
    """``match_identity`` of logs that are cut into files (``log``, ``path``, ``size``), by ``log``."""
    found = log_heads(now.join(saved.select("log", F.col("prefix_length").cast("bigint").alias("length")), "log"))
    return saved.join(found.select("log", F.col("size").alias("_size"), "sha256"), "log", "left").select("log", verdict(F.col("_size"), F.col("sha256")).alias("match"))
