"""Exports; but for sidecars, each is one Spark write, so a failed one leaves no finished output."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tidelog.functions import severity as sev
from tidelog.sources.annotations import GENERATOR, VERSION
from tidelog.sources.lines import SIDECAR
from tidelog.sources.ranges import write_files

#: Folders that sidecars are spread over.
FOLDERS = 1024


def export_text(rows: DataFrame, path: str) -> None:
    """Raw lines in the order of ``rows``."""
    rows.select("raw").write.text(path)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])


def export_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """All columns, quoted only where needed."""
    _plain(rows).write.options(header=header, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def timeline_rows(rows: DataFrame) -> DataFrame:
    tidy = lambda c: F.translate(c, "\t", " ")
    return rows.select(tidy(F.element_at(F.split("path", "/"), -1)).alias("File"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("Time"), sev.display_name(F.col("severity")).alias("Severity"), tidy(F.col("message")).alias("Message"))


def export_timeline_tsv(rows: DataFrame, path: str) -> None:
    """File, time, severity and message; no quoting, tabs become blanks."""
    out = timeline_rows(rows)
    out.select(F.concat_ws("\t", *out.columns)).write.text(path)


def annotation_rows(notes: DataFrame) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    return notes.select((F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"), "note", "color", "tag", "author", stamp("created_at"), stamp("modified_at"), "orphaned")


def export_annotations_csv(notes: DataFrame, path: str) -> None:
    """Notes with lines counted from 1."""
    export_csv(annotation_rows(notes), path)


def sidecars(notes: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id`` and the versioned JSON of its notes, by line and id, with the file's identity.

    ``files`` has ``file_id``, ``name``, ``size``, ``prefix_sha256`` and ``prefix_length``, as ``file_identity`` gives them; a file
    without notes has an empty sidecar. Empty colour, tag, author and name are left out.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    filled = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    anchor = F.struct(F.col("anchor_hash").alias("lineSha256"), "snippet")
    entry = F.struct(F.concat(F.lit("{"), "id", F.lit("}")).alias("id"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "note", filled("color"), filled("tag"), filled("author"), stamp("created_at").alias("createdAt"), stamp("modified_at").alias("modifiedAt"), anchor.alias("anchor"))
    of_file = notes.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", entry.alias("e")))), lambda x: x["e"]).alias("annotations"))
    whole = files.join(of_file, "file_id", "left")
    identity = F.struct(filled("name"), "size", F.col("prefix_sha256").alias("prefixSha256"), F.col("prefix_length").alias("prefixLength"))
    listed = F.coalesce("annotations", F.array().cast(of_file.schema["annotations"].dataType))
    return whole.select("file_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(GENERATOR).alias("generator"), identity.alias("file"), listed.alias("annotations"))).alias("value"))


def write_annotations(notes: DataFrame, files: DataFrame, path: str) -> None:
    """A sidecar per file, ``file_id=<file_id>.notes.json`` below one of ``FOLDERS`` folders.

    Tasks write the files: Spark's writer makes a folder for each and moves them one after the other. A repeated task
    writes over its files.
    """
    folder = F.pmod(F.xxhash64("file_id"), F.lit(FOLDERS)).cast("string")
    name = F.concat(F.lit(f"{path}/"), folder, F.lit("/file_id="), F.col("file_id").cast("string"), F.lit(SIDECAR))
    write_files(sidecars(notes, files).select(name.alias("path"), F.encode("value", "UTF-8").alias("content")))
