"""Golden lines and small differential tests of the log operators."""

import gzip
from datetime import datetime

import pyspark.sql.functions as F
import pytest

from tidelog.functions import predicates as X
from tidelog.functions.geo import coordinates
from tidelog.functions.timecol import normalize_time
from tidelog.operators import agg, notes, rows, timeline
from tidelog.operators import parse as P
from tidelog.operators.formats import SPECS
from tidelog.sources import lines as L

LINES = "file_id long, path string, line_no long, raw string"


@pytest.fixture(scope="module")
def make(spark):
    return lambda texts, file_id=1: spark.createDataFrame([(file_id, f"f{file_id}", i, t) for i, t in enumerate(texts)], LINES)


def test_line_splitting(spark, tmp_path):
    cases = {"empty": b"", "one": b"a\n", "open": b"a\nb", "crlf": b"a\r\nb\rc\n", "blank": b"a\n\nb"}
    for name, data in cases.items():
        (tmp_path / f"{name}.log").write_bytes(data)
        (tmp_path / f"{name}.log.gz").write_bytes(gzip.compress(data[:2]) + gzip.compress(data[2:]))
    want = {"one": ["a"], "open": ["a", "b"], "crlf": ["a", "b\rc"], "blank": ["a", "", "b"]}
    got = {}
    for r in L.read_folder(spark, str(tmp_path), ("*.log", "*.gz")).orderBy("path", "line_no").collect():
        assert r["line_no"] == len(got.setdefault(r["path"].rsplit("/", 1)[1], []))
        got[r["path"].rsplit("/", 1)[1]].append(r["raw"])
    assert got == {f"{k}.log{z}": v for k, v in want.items() for z in ("", ".gz")}


def test_numbers_across_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 90) + "é" for i in range(4000)]
    (tmp_path / "big.log").write_text("\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = L.read_lines(spark, str(tmp_path))
        got = L.line_numbers(lines).orderBy("line_no").collect()
        at = {r["line_no"]: r["byte_offset"] for r in L.line_offsets(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["raw"] for r in got] == texts and [r["line_no"] for r in got] == list(range(4000))
    offset = 0
    for r, t in zip(got, texts, strict=True):
        assert at[r["line_no"]] == offset
        offset += len(t.encode()) + 1


GOLDEN = [
    ("logcat", "01-02 03:04:05.678 1234 5678 W ActivityManager: proc died", {"PID": 1234, "TID": 5678, "Level": "Warning", "Tag": "ActivityManager", "Message": "proc died"}, 4),
    ("logcat", "[ 01-02 03:04:05.678 999: 111 E/AudioFlinger ] buffer overflow", {"PID": 999, "TID": 111, "Tag": "AudioFlinger"}, 5),
    ("logcat", "01-02 03:04:05.678 I/WifiService(  42): scan started", {"PID": 42, "TID": None, "Message": "scan started"}, 3),
    ("clf", '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326', {"Method": "GET", "Path_": "/apache_pb.gif", "Bytes": 2326, "ts_ms": 971211336000}, 0),
    ("clf", '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "-" 400 -', {"Method": "", "Path_": "", "Bytes": 0}, 0),
    ("syslog-iso", "2026-07-19T00:00:02.026813-04:00 host7 systemd[1]: rsyslog.service: Sent signal", {"Process": "systemd", "PID": 1, "Message": "rsyslog.service: Sent signal", "ts_ms": 1784433602026}, 0),
    ("jsonlines", '{"__REALTIME_TIMESTAMP":"1784922714673521","PRIORITY":"6","SYSLOG_IDENTIFIER":"systemd","MESSAGE":"m"}', {"Timestamp": "2026-07-24T19:51:54.673Z", "Level": "Info", "Source": "systemd"}, 3),
    ("jsonlines", '{"level":"warn","time":1784922714673,"name":"api","msg":"slow request"}', {"Timestamp": "1784922714673", "Message": "slow request", "ts_ms": 1784922714673}, 4),
    ("jsonlines", '{"instant":{"epochSecond":1719489344,"nanoOfSecond":123456789},"message":null}', {"Timestamp": "2024-06-27T11:55:44.123Z", "Message": ""}, 0),
    ("docker", '{"log":"panic: nil deref\\r\\n","stream":"stderr","time":"2024-03-15T08:22:45.000000001Z"}', {"Message": "panic: nil deref", "Stream": "stderr"}, 0),
    ("gelf", '{"version":"1.1","host":"e.org","short_message":"s","full_message":"f","timestamp":1385053862.3072,"level":1,"_user_id":9001,"_some_info":"foo","_id":3}', {"Extra": '{"_some_info":"foo","_user_id":9001,"full_message":"f"}', "Level": "Fatal"}, 6),
]


@pytest.mark.parametrize(("fmt", "line", "cells", "severity"), GOLDEN)
def test_golden_lines(make, fmt, line, cells, severity):
    good, bad, empty = P.parse(make([line, "no such line", ""]), fmt).orderBy("line_no").collect()
    assert good["ok"] and good["severity"] == severity
    assert {k: good[k] for k in cells} == cells
    assert not bad["ok"] and bad["severity"] == 0 and not empty["ok"]


def test_json_that_is_no_object(make):
    assert [r["ok"] for r in P.parse(make(["[1,2]", "123", "", '{"a":']), "jsonlines").collect()] == [False] * 4


def test_specs_are_sound(make):
    specs = P.registry([P.builtin_spec(s) for s in SPECS])
    assert len(specs) == 24
    for s in specs.values():
        got = P.parse_spec(make(["no such line"]), s).first()
        assert not got["ok"]
    with pytest.raises(ValueError, match="message"):
        P.spec_rules(P.Spec("x", "(?<a>.)", (P.Field("A", "a"),)))
    with pytest.raises(ValueError, match="capture"):
        P.spec_rules(P.Spec("x", "(?<a>.)", (P.Field("A", "b", "string", "message"),)))


def test_csv_records(spark):
    records = ['a,"b,c",d', '"say ""hi""",x', "a,,c", "a,b,", "  a , b ,c  ", '" a ",b', '"a"tail,b', "solo", ""]
    want = [["a", "b,c", "d"], ['say "hi"', "x"], ["a", "", "c"], ["a", "b", ""], ["a", "b", "c"], [" a ", "b"], ["atail", "b"], ["solo"], [""]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, raw string")
    assert [r["f"] for r in df.orderBy("i").select(P.csv_fields(F.col("raw")).alias("f")).collect()] == want


TIMES = [
    ("iso8601", "2026-07-01T14:30:45+02:00", "UTC", "2026-07-01 12:30:45"), ("iso8601", "2026-07-01 12:00:00", "+01:00", "2026-07-01 11:00:00"), ("iso8601", "2026-13-01T00:00:00", "UTC", None),
    ("iso8601", "", "UTC", None), ("iso8601", "not a date", "UTC", None), ("logcat", "12-30 00:00:00.000", "UTC", "2025-12-30 00:00:00"), ("klog", "0203 12:34:56.789012", "UTC", "2026-02-03 12:34:56.789"),
    ("snort", "01/18-11:07:53.123456", "UTC", "2026-01-18 11:07:53.123"), ("rfc3164", "Jul  4 06:15:02", "UTC", "2026-07-04 06:15:02"), ("rfc3164", "jUl 24 06:15:02", "UTC", "2026-07-24 06:15:02"),
    ("clf", "24/Jul/2026:06:15:02 +0200", "+01:00", "2026-07-24 04:15:02"), ("epoch-s", "1721800000.5", "UTC", "2024-07-24 05:46:40.5"), ("epoch-s", "123", "UTC", None),
    ("epoch-us", "1721800000123456", "UTC", "2024-07-24 05:46:40.123"), ("uptime", "12345.678901", "UTC", "1970-01-01 03:25:45.678"), ("MM/dd HH:mm", "12/30 06:15", "UTC", "2025-12-30 06:15:00"),
]


def test_times(spark):
    row = spark.range(1).select(*[normalize_time(F.lit(t), k, z, F.lit("2026-07-15 00:00:00").cast("timestamp")).alias(f"c{i}") for i, (k, t, z, _) in enumerate(TIMES)]).first()
    for i, (k, t, _, want) in enumerate(TIMES):
        assert row[i] == (None if want is None else X.epoch_ms(datetime.fromisoformat(want))), (k, t)


@pytest.fixture(scope="module")
def four(spark):
    """Four rows with times of 2026 and an invalid last one."""
    ms = lambda d, h: X.epoch_ms(datetime(2026, 1, d, h))
    data = [(1, 0, ms(1, 10), "01-01 10:00:00.000", 100, "Error", "WifiService", 5), (1, 1, ms(2, 11), "01-02 11:00:00.000", 200, "Info", "ActivityManager", 3),
            (1, 2, ms(3, 12), "01-03 12:00:00.000", 300, "Warning", "WifiManager", 4), (1, 3, None, "", None, "Unknown", "", 0)]
    return spark.createDataFrame(data, "file_id long, line_no long, ts_ms long, time string, pid long, level string, tag string, severity int")


PREDICATES = [
    (lambda: X.field_contains(F.col("tag"), "wifi"), [0, 2]), (lambda: X.field_wildcard(F.col("tag"), "*Manager"), [1, 2]), (lambda: X.field_cmp(F.col("tag"), "=", "WifiService"), [0]), (lambda: X.field_cmp(F.col("tag"), "!=", "WifiService"), [1, 2, 3]),
    (lambda: X.int_cmp(F.col("pid"), "<", 200), [0]), (lambda: X.int_cmp(F.col("pid"), "!=", 100), [1, 2]), (lambda: ~X.int_cmp(F.col("pid"), "=", 100), [1, 2, 3]), (lambda: ~X.field_contains(F.col("tag"), "wifi"), [1, 3]),
    (lambda: ~(X.field_contains(F.col("tag"), "wifi") | X.int_cmp(F.col("pid"), "=", 200)), [3]), (lambda: X.field_contains(F.col("time"), "01-02"), [1]), (lambda: X.severity_cmp(F.col("severity"), ">=", "warning"), [0, 2]),
    (lambda: X.severity_cmp(F.col("severity"), "!=", "info"), [0, 2, 3]), (lambda: X.severity_cmp(F.col("severity"), ":", "rror", F.col("level")), [0]), (lambda: X.time_cmp(F.col("ts_ms"), "=", datetime(2026, 1, 2), "day"), [1]),
    (lambda: X.time_cmp(F.col("ts_ms"), "!=", datetime(2026, 1, 2), "day"), [0, 2]), (lambda: X.time_cmp(F.col("ts_ms"), "<=", datetime(2026, 1, 2), "day"), [0, 1]), (lambda: X.time_cmp(F.col("ts_ms"), ">", datetime(2026, 1, 2, 11), "minute"), [2]),
    (lambda: X.time_of_day_cmp(F.col("ts_ms"), "<", 41_400_000, 41_460_000), [0, 1]), (lambda: X.time_of_day_cmp(F.col("ts_ms"), "!=", 39_600_000, 39_660_000), [0, 2]), (lambda: X.filter_regex(F.col("tag"), "(unclosed"), []),
    (lambda: ~X.filter_regex(F.col("tag"), "(unclosed"), [0, 1, 2, 3]), (lambda: X.line_filter(F.col("tag"), "", invert=True), [0, 1, 2, 3]),
]


@pytest.mark.parametrize(("build", "want"), PREDICATES)
def test_predicates(four, build, want):
    assert sorted(r["line_no"] for r in four.filter(build()).collect()) == want


def test_uptime(spark):
    df = spark.createDataFrame([(0, 1500), (1, 12345678), (2, None)], "i int, ms long")
    hit = lambda op, s: sorted(r["i"] for r in df.filter(X.uptime_cmp(F.col("ms"), op, s)).collect())
    assert [hit(">", "100"), hit("<", "100"), hit("=", "1.5"), hit(">=", "1")] == [[1], [0], [0], [0, 1]]
    with pytest.raises(ValueError):
        X.uptime_cmp(F.col("ms"), "<", "2026-01-01")


@pytest.mark.parametrize(("before", "after"), [(0, 2), (2, 0), (3, 3), (1, 1)])
def test_context(make, before, after):
    texts = [("ERROR step", "all good", "Warning: café", "debug")[i % 4] + f" {i}" for i in range(200)]
    hits = {i for i, t in enumerate(texts) if "5" in t}
    want = sorted({j for i in hits for j in range(max(0, i - before), min(199, i + after) + 1)})
    got = rows.context_lines(make(texts), X.filter_text(F.col("raw"), "5"), before, after)
    assert sorted(r["line_no"] for r in got.collect()) == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(i * 10, 3) for i in range(100)] + [(None, 0)], "ts_ms long, severity int")
    got = agg.histogram_auto(df, 10).filter("n > 0").orderBy("bucket").collect()
    assert [(r["bucket"], r["bucket_from_ms"], r["n"]) for r in got] == [(i, i * 100, 10) for i in range(10)]
    one = agg.histogram_auto(spark.createDataFrame([(777, 1)], "ts_ms long, severity int"), 4).filter("n > 0").collect()
    assert [(r["bucket"], r["n"]) for r in one] == [(0, 1)]
    assert agg.histogram_auto(df.filter("ts_ms is null"), 4).count() == 0


def test_timeline_order_and_ties(make):
    a = P.parse(make(["2024-01-01 00:00:02,000 [t] INFO l - b", "no time", "2024-01-01 00:00:01,000 [t] INFO l - a"], 2), "logback")
    b = P.parse(make(["2024-01-01 00:00:01,000 [t] WARN l - c"], 1), "logback")
    got = timeline.timeline_merge([a, b]).collect()
    assert [(r["file_id"], r["line_no"]) for r in got] == [(1, 0), (2, 2), (2, 0)]
    assert {r["file_id"]: r["dropped"] for r in timeline.timeline_dropped([a, b]).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize(("text", "want"), [
    ("10.5S, 20.25E", (-10.5, 20.25)), ("lat: -33.9249, long: 18.4241", (-33.9249, 18.4241)), ("at 33°51'22\"S, 151°12'49\"E today", (-(33 + 51 / 60 + 22 / 3600), 151 + 12 / 60 + 49 / 3600)),
    ("999.9999, 999.9999", None), ("version 1.2, 3.4", (1.2, 3.4)), ("", None), ("2024-01-02 03:04:05 none", None)])
def test_coordinates(spark, text, want):
    got = spark.range(1).select(coordinates(F.lit(text)).alias("p")).first()["p"]
    assert (got is None) == (want is None) and (want is None or tuple(got) == pytest.approx(want))


def test_notes_move_with_their_lines(spark, make):
    old = [f"unique line payload number {i}" for i in range(60)]
    new = ["inserted", *old[:20], *old[25:], "extra"]
    anchored = notes.with_anchor(make(old))
    note = anchored.filter(F.col("line_no").isin(3, 22, 40)).select("file_id", F.col("line_no").cast("string").alias("id"), F.col("line_no").alias("start_line"), (F.col("line_no") + 1).alias("end_line"), "anchor_hash")
    got = {r["id"]: (r["status"], r["new_start"], r["new_end"]) for r in notes.reanchor(note, make(new)).collect()}
    assert got == {"3": ("reanchored", 4, 5), "22": ("orphaned", 22, 23), "40": ("reanchored", 36, 37)}
    assert {r["id"] for r in notes.reanchor(note, make(old)).filter("status = 'verified'").collect()} == {"3", "22", "40"}


def test_notes_at_lines(spark, make):
    n = spark.createDataFrame([(1, "a", 100, 102), (1, "b", 5, 5), (1, "c", 101, 105)], "file_id long, id string, start_line long, end_line long")
    at = notes.annotations_at_lines(n, make(["x"] * 110), block=4).collect()
    found = lambda k: sorted(r["id"] for r in at if r["line_no"] == k)
    assert (found(101), found(4), found(5), found(103)) == (["a", "c"], [], ["b"], ["c"])


def test_a_failing_export_leaves_no_finished_file(spark, tmp_path):
    from tidelog.operators.sinks import export_text

    lines = spark.range(100).select(F.when(F.col("id") < 99, "line").otherwise(F.raise_error(F.lit("broken source"))).alias("raw"), F.col("id").alias("line_no"), F.lit(1).alias("file_id"))
    with pytest.raises(Exception, match="broken source"):
        export_text(lines, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("part-*"))


def test_a_line_is_parsed_by_few_patterns(make):
    df = P.parse(make(["x"]), "logcat", reference=F.current_timestamp()).filter(F.col("ts_ms").isNotNull()).select("ts_ms", "severity", "Message")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("regexp_replace") + plan.count("RLIKE") < 30


def test_patterns_of_the_engine(spark):
    from tidelog.functions.predicates import filter_regex, pattern_error

    df = spark.createDataFrame([("Ärger",), ("arg",)], "raw string")
    assert [r["raw"] for r in df.filter(filter_regex(F.col("raw"), r"^\p{Lu}++", case_sensitive=True)).collect()] == ["Ärger"]
    assert df.filter(filter_regex(F.col("raw"), "(")).count() == 0 and pattern_error("(") and pattern_error(r"\p{Lu}") is None
