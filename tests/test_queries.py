"""Registered queries against their SQL on DuckDB, and the driver's contract."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tidelog.plans import registry

#: One of each kind; the driver compares all.
CHECKED = [
    "parse_keyvalue", "parse_logcat", "parse_clf", "parse_jsonlines", "parse_gelf", "parse_docker", "parse_csv", "parse_w3c", "parse_netlog", "parse_cef", "parse_snort",
    "normalize_time", "assume_zone", "detect_time_format", "detect_format", "filter_text", "bool_combine", "time_cmp", "context_lines", "sort_desc", "histogram_auto",
    "histogram_range", "timeline_merge", "first_rows_at_times", "grep_truncated", "geo_points", "reanchor", "merge_annotations", "annotation_report", "line_numbers",
    "parse_spec", "spec_rules", "parse_pattern", "grep", "grep_errors", "make_anchor", "file_identity", "sort_int", "histogram_multi", "timeline_view", "read_gzip", "write_annotations", "stream_histogram", "stream_timeline",
    "severity_cmp", "at_time_range", "kept_extraction", "highlight_table", "time_span", "line_offsets", "match_identity", "grep_sound", "stream_lines", "follow_folder", "sidecar_identity", "read_annotations", "annotate_runs", "export_text", "splice",
]


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, name)


def test_contract(spark):
    names = set(registry.QUERIES)
    assert names <= set(__spark_entry__.queries()) and names == set(registry.ORACLE_SQL)
    assert __spark_entry__.entry(spark).count() == 24 * 7


def test_entry_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
