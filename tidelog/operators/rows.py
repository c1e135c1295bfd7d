"""Selections and orders of rows. ``file_id, line_no`` is the natural order and breaks every tie."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidelog.sources.scratch import stored

KEY = ["file_id", "line_no"]


def context_lines(lines: DataFrame, match: Column, before: int, after: int) -> DataFrame:
    """The lines within ``before`` and ``after`` of a match, each once: a row per match and offset joins back."""
    hits = lines.filter(F.coalesce(match, F.lit(False))).select("file_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("line_no") - before), F.col("line_no") + after)).alias("line_no"))
    return lines.join(hits.distinct(), KEY, "left_semi")


def match_count(lines: DataFrame, match: Column) -> DataFrame:
    """``matches``, before any context."""
    return lines.agg(F.count_if(F.coalesce(match, F.lit(False))).alias("matches"))


def line_constraint(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the lines of a key table."""
    return lines.join(keys.select(*KEY), KEY, "left_semi")


def lines_by_number(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines that ``keys`` (file_id, line_no, pos) names, in the order of ``pos``; others are ignored."""
    return lines.join(keys, KEY).orderBy("pos")


def sort_by(df: DataFrame, column: str | Column, descending: bool = False) -> DataFrame:
    """Stable order by a number, text or severity: invalid first; descending reverses ties as well."""
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    if descending:
        return df.orderBy(value.desc_nulls_last(), *[F.col(k).desc() for k in KEY])
    return df.orderBy(value.asc_nulls_first(), *KEY)


def sort_time(df: DataFrame, ms: str = "ts_ms", text: str = "ts_text", descending: bool = False) -> DataFrame:
    """By instant, or by text where no value of the table is an instant."""
    usable = df.filter(F.col(ms).isNotNull()).limit(1).count() > 0
    return sort_by(df, ms if usable else text, descending)


def sort_line_no(df: DataFrame, descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k) for k in KEY])


def first_n_points(points: DataFrame, n: int = 5000) -> DataFrame:
    return points.orderBy(*KEY).limit(n)


def with_place(ordered: DataFrame, column: str = "place") -> DataFrame:
    """Number the rows of a sorted table from 1, in its order.

    Sorted partitions are written with a number within each; a row per partition is summed along them.
    """
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg((F.max(inside) + 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return rows.withColumn("_part", part).join(before, "_part").withColumn(column, F.col("_before") + inside + 1).drop("_at", "_part", "_before")
