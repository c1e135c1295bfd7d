"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidelog.plans import registry  # noqa: E402

#: Read and number, substring and regex filter, extraction with a field query, merge, histogram, search, following.
HEADLINE = [
    "line_numbers", "filter_text", "filter_regex", "parse_logcat", "severity_cmp", "field_wildcard", "histogram_auto", "timeline_merge",
    "context_lines", "grep", "reanchor", "detect_format", "stream_parse_filter",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        run = registry.QUERIES[name]
        best = None
        for _ in range(2):  # the first run compiles
            began = time.time()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
