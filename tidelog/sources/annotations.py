"""Sidecar files of notes: versioned JSON into the ``annotations`` table, bad entries apart with the reason.

A sidecar has ``version``, ``generator``, ``file`` (``name``, ``size``, ``prefixSha256``, ``prefixLength``: the identity of the log it
is beside) and ``annotations``; an entry has ``id`` (a UUID, in braces or not), ``startLine``, ``endLine``, ``note``, perhaps
``color``, ``tag`` and ``author``, ``createdAt``, ``modifiedAt`` and ``anchor`` (``lineSha256``, ``snippet``).
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.ranges import whole_texts

VERSION = 1
GENERATOR = "tidelog/1"
_ENTRY = "struct<id:string,startLine:double,endLine:double,note:string,color:string,tag:string,author:string,createdAt:string,modifiedAt:string,anchor:struct<lineSha256:string,snippet:string>>"
_FILE = "struct<version:string,file:struct<name:string,size:double,prefixSha256:string,prefixLength:double>,annotations:array<string>>"
_UUID = r"(?i)^(\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
_NIL = "00000000-0000-0000-0000-000000000000"


def read_annotations(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, rejected, files): sidecars that are no JSON object or of another version are rejected whole, entries one by
    one; ``files`` has the identity that each sidecar keeps of its log, for ``match_identity``."""
    return parse_annotations(whole_texts(spark, paths))


def parse_annotations(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a table of ``path``, ``value`` (the JSON). Where a sidecar repeats an id, its last entry stays."""
    files = text.select("path", F.try_parse_json("value").isNotNull().alias("json"), F.from_json("value", _FILE).alias("f"))
    sound = F.col("json") & F.coalesce(F.col("f.version").try_cast("double") == VERSION, F.lit(False))
    entries = files.filter(sound).select("path", F.posexplode("f.annotations").alias("at", "entry"))
    e = F.col("a")
    read = entries.select("path", "at", "entry", F.from_json("entry", _ENTRY).alias("a"))
    start, end = (F.coalesce(e[c], F.lit(-1.0)).cast("bigint") for c in ("startLine", "endLine"))
    plain = F.lower(F.translate(e["id"], "{}", ""))
    reason = (
        F.when(~F.startswith(F.ltrim("entry"), F.lit("{")) | e.isNull(), "not an object")
        .when(~F.coalesce(F.rlike(e["id"], F.lit(_UUID)) & (plain != _NIL), F.lit(False)), "missing or invalid id")
        .when((start < 0) | (end < start), "invalid line range")
        .when(~F.array_contains(F.json_object_keys("entry"), "note"), "missing note")
        .when(F.coalesce(e["anchor"]["lineSha256"] == "", F.lit(True)), "missing anchor"))
    judged = read.withColumn("reason", reason)
    time = lambda c: F.try_to_timestamp(e[c])
    text_of = lambda c: F.coalesce(e[c], F.lit(""))
    note = F.struct(
        start.alias("start_line"), end.alias("end_line"), *[text_of(c).alias(c) for c in ("note", "color", "tag", "author")], time("createdAt").alias("created_at"),
        time("modifiedAt").alias("modified_at"), e["anchor"]["lineSha256"].alias("anchor_hash"), F.coalesce(e["anchor"]["snippet"], F.lit("")).alias("snippet"), F.lit(False).alias("orphaned"))
    notes = judged.filter("reason is null").groupBy("path", plain.alias("id")).agg(F.max_by(note, "at").alias("n")).select("path", "id", "n.*")
    whole = F.when(~F.col("json"), "invalid JSON").otherwise("unsupported version")
    versions = files.filter(~sound).select("path", F.lit(None).cast("string").alias("entry"), whole.alias("reason"))
    rejected = judged.filter("reason is not null").select("path", "entry", "reason").unionByName(versions)
    number = lambda c: F.coalesce(F.col(f"f.file.{c}"), F.lit(0.0))
    identities = files.filter(sound).select(
        "path", F.coalesce("f.file.name", F.lit("")).alias("name"), number("size").cast("bigint").alias("size"),
        number("prefixLength").cast("int").alias("prefix_length"), F.coalesce("f.file.prefixSha256", F.lit("")).alias("prefix_sha256"))
    return notes, rejected, identities
