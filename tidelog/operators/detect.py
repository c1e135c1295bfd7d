"""Which format a file has: the matched share of a bounded sample times the format's specificity."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidelog.operators import parse as P
from tidelog.operators.formats import SPECS

#: The sample: non-empty lines among the first bytes of a file.
SAMPLE_LINES, SAMPLE_BYTES = 200, 1 << 20
# Specificity of the formats without a declared one, and the order that breaks ties.
SPECIFICITY = {"docker": 0.97, "gelf": 0.97, "netlog": 0.97, "jsonlines": 0.95, "clf": 1.0, "logcat": 0.9, "w3c": 0.9, "csv": 0.6, "plaintext": 0.05}
ORDER = ("docker", "gelf", "jsonlines", "clf", "logcat", *SPECS, "plaintext")


def structure_match(fmt: str, columns: int | None = None) -> Column:
    """Whether ``raw`` has the structure of a format (for csv and w3c: of that many columns)."""
    raw = F.col("raw")
    if fmt == "plaintext":
        found = F.lit(True)
    elif fmt == "logcat":
        found = F.lit(False)
        for pattern, _ in P.LOGCAT:
            found = found | F.rlike(raw, F.lit("(?d)" + pattern))
    elif fmt == "clf":
        found = F.rlike(raw, F.lit("(?d)" + P.CLF))
    elif fmt in ("jsonlines", "docker", "gelf"):
        keys = F.when(F.try_parse_json(raw).isNotNull() & F.rlike(raw, F.lit(r"^\s*\{")), F.json_object_keys(raw))
        need = {"docker": ("log", "stream", "time"), "gelf": ("version", "host", "short_message")}.get(fmt, ())
        found = keys.isNotNull()
        for k in need:
            found = found & F.array_contains(keys, k)
    elif fmt == "csv":
        n = F.size(P.csv_fields(raw))
        found = (n >= 2) & (n == columns if columns else F.lit(True))
    elif fmt == "w3c":
        found = F.startswith(F.ltrim(raw), F.lit("#")) | (F.size(F.split(F.trim(F.regexp_replace(raw, r"\s+", " ")), " ")) == (columns or 0))
    elif fmt == "netlog":
        found = F.rlike(raw, F.lit(r'^\s*\{.*"source":\{.*"type":\d+'))
    else:
        found = F.rlike(raw, F.lit("(?d)" + SPECS[fmt]["pattern"]))
    return F.coalesce(found, F.lit(False))


def specificity(fmt: str) -> float:
    return SPECS[fmt]["specificity"] if fmt in SPECS else SPECIFICITY[fmt]


def format_scores(lines: DataFrame, formats: Sequence[str] = ORDER) -> DataFrame:
    """``file_id``, ``format``, ``score`` of every file and format; a row per file is one struct of counts."""
    first = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    near = lines.filter((F.coalesce(F.col("byte_offset"), F.col("line_no")) < SAMPLE_BYTES) & (F.col("raw") != ""))
    sample = near.withColumn("_n", first).filter(F.col("_n") <= SAMPLE_LINES)
    counted = sample.groupBy("file_id").agg(F.count("*").alias("_all"), *[F.count_if(structure_match(f)).alias(f) for f in formats])
    pairs = F.array(*[F.struct(F.lit(f).alias("format"), F.lit(i).alias("rank"), (F.col(f"`{f}`") / F.col("_all") * specificity(f)).alias("score")) for i, f in enumerate(formats)])
    return counted.select("file_id", F.explode(pairs).alias("s")).select("file_id", "s.*")


def detect_format(lines: DataFrame, formats: Sequence[str] = ORDER, files: DataFrame | None = None) -> DataFrame:
    """``file_id``, ``format``, ``score``: the best format, ties by the list; plain text where nothing is to see."""
    best = format_scores(lines, formats).filter("score > 0").groupBy("file_id").agg(F.max_by(F.struct("format", "score"), F.struct("score", -F.col("rank"))).alias("b")).select("file_id", "b.format", "b.score")
    all_files = lines.select("file_id").distinct() if files is None else files.select("file_id")
    return all_files.join(best, "file_id", "left").select("file_id", F.coalesce("format", F.lit("plaintext")).alias("format"), F.coalesce("score", F.lit(0.0)).alias("score"))
