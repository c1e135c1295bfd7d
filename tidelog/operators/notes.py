"""Notes on line ranges: anchors, merging, finding moved lines, reports. Notes carry the ``file_id`` they are on."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

#: Bytes of a line that its anchor hashes, characters of a snippet, lines around the saved place that are searched.
ANCHOR_BYTES, SNIPPET, WINDOW_LINES, REPORT_LINES = 256, 80, 100_000, 50


def make_anchor(raw: Column) -> Column:
    return F.sha2(F.substring(F.encode(raw, "UTF-8"), 1, ANCHOR_BYTES), 256)


def with_anchor(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"anchor_hash": make_anchor(F.col("raw")), "snippet": F.left("raw", F.lit(SNIPPET))})


def annotate_runs(selected: DataFrame, block: int = 65_536) -> DataFrame:
    """Selected lines to one range per contiguous run.

    Runs are found within blocks of lines first, so a file of any size is spread; only those that touch the border of
    their block, two per block at most, meet those of the file's other blocks.
    """
    _b = F.floor(F.col("line_no") / block)
    lines = selected.select("file_id", "line_no").distinct().withColumn("_b", _b)
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_id", "_b").orderBy("line_no"))
    runs = lines.withColumn("_i", island).groupBy("file_id", "_b", "_i").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    at_border = (F.col("start_line") % block == 0) | (F.col("end_line") % block == block - 1)
    along = Window.partitionBy("file_id").orderBy("start_line")  # two rows per block of lines
    border = runs.filter(at_border).withColumn("_new", F.coalesce(F.col("start_line") != F.lag("end_line").over(along) + 1, F.lit(True)).cast("long"))
    border = border.withColumn("_g", F.sum("_new").over(along)).groupBy("file_id", "_g").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    columns = ["file_id", "start_line", "end_line"]
    return runs.filter(~at_border).select(*columns).union(border.select(*columns))


def annotations_at_lines(notes: DataFrame, lines: DataFrame, block: int = 1024) -> DataFrame:
    """``file_id``, ``line_no``, ``id`` of the notes that cover each line: a range join by blocks of lines."""
    spread = notes.select("file_id", "id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("_b"))
    at = lines.select("file_id", "line_no", F.floor(F.col("line_no") / block).alias("_b"))
    return at.join(spread, ["file_id", "_b"]).filter(F.col("line_no").between(F.col("start_line"), F.col("end_line"))).select("file_id", "line_no", "id")


def merge_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by id: the later modification wins, then the first table."""
    both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("modified_at").desc_nulls_last(), "_src"))
    return both.withColumn("_n", latest).filter("_n = 1").drop("_n", "_src")


def upsert_annotations(notes: DataFrame, new: DataFrame) -> DataFrame:
    return notes.join(new.select("id"), "id", "left_anti").unionByName(new)


def delete_annotations(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id"), "id", "left_anti")


def reanchor(notes: DataFrame, lines: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """Move notes to where their lines are now; adds ``new_start``, ``new_end`` and ``status``.

    A note whose saved line still has its hash is verified. Else the shift that most notes of the file would
    fit decides, where it fits; else the nearest line of equal hash within ``window`` (ties: the lower);
    else it is orphaned and stays. Hashes join by equality within blocks of ``window`` lines, so a line text
    that repeats through a file meets a note only near its place.
    """
    block = lambda c: F.floor(c / window)
    hashed = lines.select("file_id", "line_no", make_anchor(F.col("raw")).alias("anchor_hash"))
    near = notes.select("file_id", "id", "anchor_hash", "start_line", F.explode(F.array(*[block(F.col("start_line")) + d for d in (-1, 0, 1)])).alias("_b"))
    found = near.join(hashed.withColumn("_b", block(F.col("line_no"))), ["file_id", "anchor_hash", "_b"]).withColumn("shift", F.col("line_no") - F.col("start_line")).filter(F.abs("shift") <= window)
    nearest = found.groupBy("file_id", "id").agg(F.min_by("shift", F.struct(F.abs("shift"), F.col("line_no"))).alias("nearest"))
    votes = found.groupBy("file_id", "shift").agg(F.count("*").alias("_v"))
    common = votes.filter("shift <> 0").groupBy("file_id").agg(F.max_by("shift", F.struct("_v", -F.abs("shift"), -F.col("shift"))).alias("common"))
    fits = found.join(common, "file_id").filter("shift = common").select("file_id", "id", "common")
    last = lines.groupBy("file_id").agg(F.max("line_no").alias("_last"))
    out = notes.join(nearest, ["file_id", "id"], "left").join(fits, ["file_id", "id"], "left").join(last, "file_id", "left")
    shift = F.when(F.col("nearest") == 0, 0).otherwise(F.coalesce("common", "nearest"))
    status = F.when(shift.isNull(), "orphaned").when(shift == 0, "verified").otherwise("reanchored")
    start = F.col("start_line") + F.coalesce(shift, F.lit(0))
    end = F.when(shift.isNull(), F.col("end_line")).otherwise(F.least(F.col("end_line") + shift, F.col("_last")))
    return out.withColumns({"new_start": start, "new_end": end, "status": status}).drop("nearest", "common", "_last")


def reanchor_stats(anchored: DataFrame) -> DataFrame:
    return anchored.groupBy("status").agg(F.count("*").alias("n"))


def annotation_counts(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("notes"), F.count_if("orphaned").alias("orphaned"))


def annotation_report(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """Each note with its first lines, or its snippet where it is orphaned."""
    head = notes.withColumn("end_line", F.least("end_line", F.col("start_line") + REPORT_LINES - 1)).filter(~F.col("orphaned"))
    covered = annotations_at_lines(head, lines).join(lines.select("file_id", "line_no", "raw"), ["file_id", "line_no"])
    texts = covered.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("lines"))
    return notes.join(texts, "id", "left").withColumn("lines", F.when(F.col("orphaned"), F.array("snippet")).otherwise(F.coalesce("lines", F.array().cast("array<string>"))))
