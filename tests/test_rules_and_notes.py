"""Rules from a table, sidecars of version 1, time spans, narrow parses."""

import json
import random
import re

import pyspark.sql.functions as F
import pytest

from tidelog.operators import agg, rules, sinks
from tidelog.operators import parse as P
from tidelog.sources import annotations as A

LINES = "file_id long, path string, line_no long, raw string"


def first_color(text, table):
    for _, pattern, color, regex, cased, enabled in sorted(table):
        if enabled is False or not pattern or not color:
            continue
        if regex:
            try:
                hit = re.search(pattern, text, 0 if cased else re.I)
            except re.error:
                continue
        else:
            hit = pattern in text if cased else pattern.lower() in text.lower()
        if hit:
            return color
    return None


@pytest.mark.parametrize("sent", [0, 200_000])
def test_rules_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(rules, "SENT", sent)
    rng = random.Random(sent)
    word = lambda: "".join(rng.choice("abcAB xé.\n") for _ in range(rng.randint(0, 5)))
    table = [(i, word(), rng.choice(["red", "blue", "green"]), False, rng.random() < 0.3, rng.choice([True, True, None, False])) for i in range(60)]
    table += [(100, "a.b", "dots", True, False, True), (101, "(", "broken", True, False, True), (102, "^A", "start", True, True, True), (103, "abc", "", False, False, True), (104, "ABC", None, False, False, True), (1, "cab", "early", False, False, True)]
    rng.shuffle(table)
    texts = ["".join(word() for _ in range(6)) for _ in range(200)] + ["", "x" * 100_000 + "cab", None]
    lines = spark.createDataFrame([(1, "f", i, t) for i, t in enumerate(texts)], LINES).withColumn("color", F.lit("old"))
    got = {r["line_no"]: r["color"] for r in rules.highlight_by_table(lines, spark.createDataFrame(table, rules.RULES)).collect()}
    seen = {p for p, *_ in table}
    assert len(seen) == len(table) - 1  # one priority twice: either may win
    want = {i: None if t is None else first_color(t.replace("\n", "\n"), table) for i, t in enumerate(texts)}
    odd = [i for i in want if want[i] != got[i] and not (texts[i] and {want[i], got[i]} <= {c for p, _, c, *_ in table if p == 1})]
    assert not odd, [(texts[i], want[i], got[i]) for i in odd[:3]]


def test_too_many_expressions(spark, monkeypatch):
    monkeypatch.setattr(rules, "TRIED", 2)
    table = spark.createDataFrame([(i, "a.c", "red", True, False, True) for i in range(3)], rules.RULES)
    with pytest.raises(ValueError, match="more than 2"):
        rules.highlight_by_table(spark.createDataFrame([], LINES), table)


GOLDEN = {
    "version": 1, "generator": "some program",
    "file": {"name": "app.log", "size": 5_000_000_000, "prefixSha256": "ab" * 32, "prefixLength": 65536},
    "annotations": [
        {"id": "{0a1b2c3d-0000-4000-8000-000000000001}", "startLine": 3, "endLine": 5, "note": "first\nline", "color": "#ff0000", "tag": "bug", "author": "me", "createdAt": "2026-01-02T03:04:05.678Z", "modifiedAt": "2026-01-02T03:04:06.000Z", "anchor": {"lineSha256": "cd" * 32, "snippet": "text é"}},
        {"id": "{0a1b2c3d-0000-4000-8000-000000000002}", "startLine": 9, "endLine": 9, "note": "", "createdAt": "2026-01-02T03:04:05.000Z", "modifiedAt": "2026-01-02T03:04:05.000Z", "anchor": {"lineSha256": "ef" * 32, "snippet": ""}},
    ],
}


def test_a_golden_sidecar_is_read_and_written_back(spark, tmp_path):
    (tmp_path / "app.log.notes.json").write_text(json.dumps(GOLDEN, indent=4))
    notes, rejected, files = A.read_annotations(spark, str(tmp_path))
    assert rejected.count() == 0 and notes.count() == 2
    with_id = lambda df: df.withColumn("file_id", F.lit(7).cast("long"))
    back = json.loads(sinks.sidecars(with_id(notes), with_id(files)).first()["value"])
    assert back.pop("generator") and back == {k: v for k, v in GOLDEN.items() if k != "generator"}


def test_broken_sidecars(spark):
    entry = GOLDEN["annotations"][0]
    nil = dict(entry, id="{" + A._NIL + "}")
    plain = dict(entry, id=entry["id"].strip("{}").upper(), note="later")
    cases = {
        "cut": json.dumps(GOLDEN)[:-3], "list": "[1]", "newer": json.dumps(GOLDEN | {"version": 2}), "none": "", "nil": json.dumps(GOLDEN | {"annotations": [nil]}),
        "half": json.dumps(GOLDEN | {"annotations": [dict(entry, id="{" + entry["id"][1:-1])]}), "twice": json.dumps(GOLDEN | {"annotations": [entry, plain]}),
        "bare": json.dumps({"version": 1}), "odd": json.dumps(GOLDEN | {"annotations": [entry | {"startLine": "x"}, entry | {"anchor": {}}, {k: v for k, v in entry.items() if k != "note"}, 5]}),
    }
    notes, rejected, files = A.parse_annotations(spark.createDataFrame(list(cases.items()), "path string, value string"))
    got = [(r["path"], r["id"], r["note"]) for r in notes.collect()]
    assert got == [("twice", entry["id"][1:-1], "later")]
    assert sorted((r["path"], r["reason"]) for r in rejected.collect()) == sorted([
        ("cut", "invalid JSON"), ("none", "invalid JSON"), ("list", "unsupported version"), ("newer", "unsupported version"), ("nil", "missing or invalid id"), ("half", "missing or invalid id"),
        ("odd", "invalid line range"), ("odd", "missing anchor"), ("odd", "missing note"), ("odd", "not an object")])
    assert {r["path"]: r["size"] for r in files.collect()} == {"nil": 5_000_000_000, "half": 5_000_000_000, "twice": 5_000_000_000, "odd": 5_000_000_000, "bare": 0}


def test_spans_know_times_since_boot(spark):
    make = lambda rows: spark.createDataFrame([(f, "f", i, t) for i, (f, t) in enumerate(rows)], LINES)
    boot = agg.time_span(P.parse(make([(1, "[   12.500000] a"), (1, "[   13.250000] b"), (1, "none")]), "dmesg")).collect()
    assert [tuple(r) for r in boot] == [(1, 12_500, 13_250, True)]
    told = agg.time_span(P.parse(make([(1, "ts=2024-01-01T00:00:01Z level=info msg=a"), (2, "ts=2024-01-01T00:00:02Z level=info msg=b"), (3, "nothing")]), "keyvalue")).collect()
    assert sorted(tuple(r) for r in told) == [(1, 1704067201000, 1704067201000, False), (2, 1704067202000, 1704067202000, False), (3, None, None, False)]
    assert [tuple(r) for r in agg.time_span(P.parse(make([(1, "x")]), "plaintext")).collect()] == [(1, None, None, False)]


@pytest.mark.parametrize("fmt", ["keyvalue", "logcat", "clf", "jsonlines", "docker", "gelf", "plaintext", "csv"])
def test_narrow_parses_equal_whole_ones(spark, fmt):
    texts = ["ts=2024-01-01T00:00:01Z level=info msg=a", "01-02 03:04:05.678 1234 5678 W Tag: died", '{"ts":"2024-01-01T00:00:00Z","level":"warn","msg":"m"}', '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 1', "a,b", ""]
    lines = spark.createDataFrame([(1, "f", i, t) for i, t in enumerate(texts)], LINES)
    whole = P.parse(lines, fmt, **({"reference": F.lit("2024-06-01").cast("timestamp")} if fmt == "logcat" else {}))
    for c in [c for c in whole.columns if c not in lines.columns]:
        narrow = P.parse(lines, fmt, columns=[c], **({"reference": F.lit("2024-06-01").cast("timestamp")} if fmt == "logcat" else {}))
        assert narrow.schema[c] == whole.schema[c]
        assert [r[c] for r in narrow.orderBy("line_no").collect()] == [r[c] for r in whole.orderBy("line_no").collect()]


def test_what_is_not_wanted_is_not_planned(spark):
    lines = spark.createDataFrame([(1, "f", 0, "x")], LINES)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    message, level, none = (plan(P.extract(lines, "keyvalue", *c, with_severity=s)) for c, s in ((("Message",), False), ((), True), ((), False)))
    assert "timestamp" not in message.lower() and "regexp_replace" in message and "severity" not in message
    assert "timestamp" not in level.lower() and "severity" in level
    assert "regexp" not in none and "inline" not in none
    assert "timestamp" in plan(P.extract(lines, "keyvalue", "ts_ms")).lower()
