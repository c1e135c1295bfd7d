"""Highlighting by a table of rules, of which there may be many.

Rules have ``priority`` (the least of those that match wins), ``pattern``, ``color``, ``regex``, ``case_sensitive`` and ``enabled``.
Needles meet lines in an equi-join on one run of three characters of theirs, the one that is rarest among some of the
lines, and are then looked for in full; so a line is compared with the few rules that it may hold. Expressions, and
needles that are too short or whose case folds beyond A-Z, are tried on every line, and their number is bounded.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.functions.predicates import fold, line_filter

#: Characters of a run, lines among which its frequency is told (that decides speed, not results), rules that may be
#: tried on every line, and needles that may be sent to every task.
RUN, SAMPLE, TRIED, SENT = 3, 20_000, 1000, 200_000
RULES = "priority long, pattern string, color string, regex boolean, case_sensitive boolean, enabled boolean"


def usable(rules: DataFrame) -> DataFrame:
    """The rules that can match: enabled, with a pattern and a colour; missing flags are false, a missing ``enabled`` true."""
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return rules.filter(F.coalesce("enabled", F.lit(True)) & (F.col("pattern") != "") & (F.col("color") != "")).select("priority", "pattern", "color", flag("regex", False), flag("case_sensitive", False))


def runs_of(text: Column) -> Column:
    """The distinct runs of RUN characters, A-Z folded."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1)))


def highlight_by_table(lines: DataFrame, rules: DataFrame, text: str = "raw", key: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """``lines`` (one row per ``key``) with ``color``, that of the first rule that matches ``text``, or null.

    More than TRIED rules that have to be tried on every line raise ValueError.
    """
    rules = usable(rules)
    by_run = ~F.col("regex") & (F.length("pattern") >= RUN) & (F.col("case_sensitive") | F.rlike("pattern", F.lit(r"\A\p{ASCII}*\z")))
    needles, others = rules.filter(by_run), rules.filter(~by_run).limit(TRIED + 1).collect()
    if len(others) > TRIED:
        raise ValueError(f"more than {TRIED} rules are expressions or have no run of {RUN} characters")
    told = [F.when(line_filter(F.col("_text"), r["pattern"], r["regex"], r["case_sensitive"]), F.struct(F.lit(r["priority"]).cast("bigint").alias("priority"), F.lit(r["color"]).alias("color"))) for r in others]
    own = lines.select(*key, F.col(text).alias("_text"))
    seen = own.limit(SAMPLE).select(F.explode(runs_of(F.col("_text"))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    each = needles.select("*", F.explode(runs_of(F.col("pattern"))).alias("run")).join(seen, "run", "left")
    rarest = each.groupBy("priority", "pattern", "color", "case_sensitive").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
    rarest = F.broadcast(rarest) if needles.count() <= SENT else rarest
    holds = F.when(F.col("case_sensitive"), F.contains("_text", F.col("pattern"))).otherwise(F.contains(fold(F.col("_text")), fold(F.col("pattern"))))
    met = own.select("*", F.explode(runs_of(F.col("_text"))).alias("run")).join(rarest, "run").filter(holds)
    hits = met.select(*key, F.struct(F.col("priority").cast("bigint").alias("priority"), "color").alias("rule"))
    if told:
        tried = own.select(*key, F.explode(F.array_compact(F.array(*told))).alias("rule"))
        hits = hits.union(tried)
    first = hits.groupBy(*key).agg(F.min("rule")["color"].alias("color"))
    return lines.drop("color").join(first, list(key), "left")
