"""Ranges of files, identities, kept extractions and following, against plain reads."""

import gzip
import hashlib
import os
import random
from datetime import datetime

import pyspark.sql.functions as F
import pytest

from tidelog.functions import predicates as X
from tidelog.operators import notes, search
from tidelog.operators import parse as P
from tidelog.sources import extraction as E
from tidelog.sources import lines as L
from tidelog.sources import ranges
from tidelog.streaming import follow


def split(data: bytes, at: int = 0):
    """(offset, bytes) of the lines of a file."""
    out = []
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        out.append((at, data[at:end]))
        at = end + 1
    return out


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_lines_of_a_range(monkeypatch, tmp_path, piece):
    monkeypatch.setattr(ranges, "PIECE", piece)
    rng = random.Random(piece)
    for k in range(30):
        data = b"".join(rng.choice([b"\n", b"a", b"bc", b"\r\n"]) for _ in range(rng.randint(0, 40)))
        path = tmp_path / f"{k}"
        path.write_bytes(data)
        want = split(data)
        for width in (1, 4, 100):
            got = []
            for low in range(0, len(data), width):
                high = min(low + width, len(data))
                first = sum(ranges.line_ends(f"file:{path}", a - (a > 0), min(a + width, len(data)) - 1) for a in range(0, low, width)) + (low > 0)
                found = [x for part in ranges.lines_from(f"file:{path}", low, high, len(data), low == 0) for x in part]
                assert not found or first == len(got)
                got += found
            assert [(o, b) for o, b, _ in got] == want
            assert all(ended == (o + len(b) < len(data)) for o, b, ended in got)


def test_read_from(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 50)
    texts = {f: "".join(f"{f} line {i} {'x' * (i % 70)}\n" for i in range(200)) + ("open" if f == "b" else "") for f in "ab"}
    for f, t in texts.items():
        (tmp_path / f).write_text(t)
    at = texts["a"].index("a line 7 ")
    files = spark.createDataFrame([(f"file:{tmp_path}/a", at, 7, len(texts["a"])), (f"file:{tmp_path}/b", 0, 0, len(texts["b"])), (f"file:{tmp_path}/b", 5, 0, 5)], "path string, from_byte long, first_line long, size long")
    got = ranges.read_from(files).collect()
    for f, skip in (("a", 7), ("b", 0)):
        own = sorted((r["line_no"], r["byte_offset"], r["raw"]) for r in got if r["path"].endswith(f))
        assert own == [(n, o, b.decode()) for n, (o, b) in enumerate(split(texts[f].encode()))][skip:]
    assert [r["raw"] for r in got if not r["terminated"]] == ["open"]


def test_identities_of_files(spark, tmp_path):
    big = os.urandom(300_000)
    contents = {"same": b"abc", "grown": big, "cut": big, "turned": b"xyz", "gone": b"q"}
    for n, c in contents.items():
        (tmp_path / n).write_bytes(c)
    saved = L.file_identity(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in saved.collect()}
    assert all((rows[n]["size"], rows[n]["prefix_length"], rows[n]["prefix_sha256"]) == (len(c), min(len(c), L.PREFIX), hashlib.sha256(c[: L.PREFIX]).hexdigest()) for n, c in contents.items())
    saved = spark.createDataFrame(saved.collect(), saved.schema)
    (tmp_path / "grown").write_bytes(big + b"more")
    (tmp_path / "cut").write_bytes(big[:100_000])
    (tmp_path / "turned").write_bytes(b"xyZ!")
    (tmp_path / "gone").unlink()
    got = {r["path"].rsplit("/", 1)[1]: r["match"] for r in L.match_identity(saved, ranges.listed(spark, str(tmp_path))).collect()}
    assert got == {"same": "Identical", "grown": "Grown", "cut": "Mismatch", "turned": "Mismatch", "gone": "Mismatch"}


def test_rejected_files(spark, tmp_path):
    whole = gzip.compress(b"one\ntwo\n" * 5000)
    files = {"good.gz": whole + gzip.compress(b"more\n"), "cut.gz": whole[: len(whole) // 2], "bad.gz": whole[:30] + b"\x00" * 20 + whole[50:], "no.gz": b"plain", "plain.log": b"x\n", "zero.gz": b""}
    for n, c in files.items():
        (tmp_path / n).write_bytes(c)
    listing = ranges.listed(spark, str(tmp_path))
    listing = listing.union(spark.createDataFrame([(f"file:{tmp_path}/lost.log", 9)], listing.schema))
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in search.grep_errors(listing).collect()}
    assert got == {"cut.gz": "truncated gzip stream", "bad.gz": "corrupt gzip stream", "no.gz": "corrupt gzip stream", "lost.log": "unreadable: FileNotFoundError"}
    sound = search.read_sound(spark, listing, search.grep_errors(listing))
    assert {r["path"].rsplit("/", 1)[1]: r["count"] for r in sound.groupBy("path").count().collect()} == {"good.gz": 10_001, "plain.log": 1}


def test_numbers_move_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n" * 1000)
    plan = L.read_folder(spark, str(tmp_path)).select("path", "line_no", "raw")._jdf.queryExecution().executedPlan().toString()
    text_side, *rest = plan.split("BroadcastExchange")
    assert "FileScan text" in text_side and "Exchange" not in text_side and rest and "SortMergeJoin" not in plan


@pytest.mark.parametrize("block", [1, 4, 65_536])
def test_runs_across_blocks(spark, block):
    rng = random.Random(block)
    rows = [(f, n) for f in range(3) for n in range(60) if rng.random() < 0.8] + [(1, 5)]
    want = []
    for f, n in sorted(set(rows)):
        if want and want[-1][0] == f and want[-1][2] == n - 1:
            want[-1][2] = n
        else:
            want.append([f, n, n])
    got = notes.annotate_runs(spark.createDataFrame(rows, "file_id long, line_no long"), block)
    assert sorted([r["file_id"], r["start_line"], r["end_line"]] for r in got.collect()) == want


KV = "ts=2024-01-{:02d}T00:00:{:02d}Z level=warn code={} msg=\"m {}\""


def kv_lines(spark, first, last, file_id=1):
    rows = [(file_id, "f", n, KV.format(n % 28 + 1, n % 60, n, n)) for n in range(first, last)]
    return P.parse(spark.createDataFrame(rows, "file_id long, path string, line_no long, raw string"), "keyvalue")


def test_kept_extraction(spark, tmp_path):
    store = str(tmp_path / "store")
    E.write_load(kv_lines(spark, 0, 300).unionByName(kv_lines(spark, 0, 300, 2)), store, 0)
    tail = spark.createDataFrame([(1, 250)], "file_id long, first_line long")
    for _ in range(2):
        E.write_load(kv_lines(spark, 250, 400), store, 1, tail)
    df = E.read_store(spark, store)
    assert sorted((r["file_id"], r["line_no"]) for r in df.collect()) == [(1, n) for n in range(400)] + [(2, n) for n in range(300)]
    found = E.at_time(E.at_time(df, ">=", datetime(2024, 1, 5)), "<", datetime(2024, 1, 7)).filter(X.severity_cmp(F.col("severity"), ">=", "warning") & X.int_cmp(F.col("Code"), ">", 100)).select("file_id", "line_no")
    assert sorted((r[0], r[1]) for r in found.collect()) == [(f, n) for f, end in ((1, 400), (2, 300)) for n in range(101, end) if n % 28 in (4, 5)]
    plan = found._jdf.queryExecution().sparkPlan().toString()  # long lists are cut short in it
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [GreaterThanOrEqual(ts_ms,1704412800000), IsNotNull(ts_ms), LessThan(ts_ms,1704585600000)" in plan
    assert "ReadSchema: struct<file_id:bigint,line_no:bigint,severity:tinyint,ts_ms:bigint,Code:bigint>" in plan
    plan = df.filter(X.severity_cmp(F.col("severity"), ">=", "warning") & X.int_cmp(F.col("Code"), ">", 100))._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [GreaterThanOrEqual(severity,4), IsNotNull(severity), GreaterThan(Code,100)" in plan


def test_extraction_is_kept_while_its_files_stay(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    made = []

    def extract():
        made.append(1)
        return kv_lines(spark, 0, 5)

    for _ in range(3):
        assert E.kept(spark, [str(tmp_path)], f"t-{tmp_path.name}", extract).count() == 5
    (tmp_path / "a.log").write_text("x\ny\n")
    E.kept(spark, [str(tmp_path)], f"t-{tmp_path.name}", extract).count()
    assert len(made) == 2


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for number in (0, 1, 1):
        follow.put_timeline(kv_lines(spark, number * 10, number * 10 + 10), number, path)
    assert spark.read.option("basePath", path).parquet(f"{path}/batch=*").count() == 20


def test_segments_numbered_on(spark, tmp_path):
    def batch(*segments):
        rows = [(f"{log}/{name}", 0, text, len(text) + 1) for log, name, texts in segments for text in texts]
        return spark.createDataFrame(rows, "path string, block_start long, raw string, size long").coalesce(1)

    path, log = str(tmp_path / "n"), F.split("path", "/")[0]
    first, second = [("a", "1", ["x", "yy"]), ("a", "2", ["z"]), ("b", "1", ["q"])], [("a", "3", ["", "w"]), ("c", "1", ["c"])]
    for number, segments in ((0, first), (1, second), (1, second)):
        follow.number_batch(batch(*segments), number, path, log)
    got = sorted((r["log"], r["line_no"], r["byte_offset"], r["raw"]) for r in follow.numbered_segments(spark, path).collect())
    assert got == [("a", 0, 0, "x"), ("a", 1, 2, "yy"), ("a", 2, 5, "z"), ("a", 3, 7, ""), ("a", 4, 8, "w"), ("b", 0, 0, "q"), ("c", 0, 0, "c")]


def test_a_look_that_broke_off(spark, tmp_path, monkeypatch):
    """A look that wrote its load but no registry, and files that changed before it was repeated."""
    folder, table = tmp_path / "logs", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a").write_text(KV.format(1, 1, 1, 1) + "\n")
    parse = lambda lines: P.parse(lines, "keyvalue")
    whole = follow.stored

    def broken(df, name):
        if name == "registry":
            raise RuntimeError("lost")
        return whole(df, name)

    monkeypatch.setattr(follow, "stored", broken)
    with pytest.raises(RuntimeError):
        follow.look(spark, str(folder), table, parse, 0)
    monkeypatch.undo()
    (folder / "a").write_text("".join(KV.format(n, n, n, n) + "\n" for n in (1, 2, 3)))
    follow.look(spark, str(folder), table, parse, 0)
    assert sorted(r["Code"] for r in follow.followed(spark, table).collect()) == [1, 2, 3]


def test_a_followed_folder(spark, tmp_path):
    folder, table = tmp_path / "logs", str(tmp_path / "table")
    folder.mkdir()
    line = lambda n: KV.format(n % 28 + 1, n % 60, n, n) + "\n"
    looks = [
        {"still": line(1) * 2, "grows": line(1) + line(2)[:-1], "turns": line(3) * 4, "goes": line(4)},
        {"still": line(1) * 2, "grows": line(1) + line(2)[:-5] + "tail\"\n" + line(3), "turns": line(5), "new": line(6) + "open"},
        {"still": line(1) * 2, "grows": line(1) + line(2)[:-5] + "tail\"\n" + line(3) + line(4), "turns": line(5) + line(6), "new": ""},
    ]
    for number, files in enumerate([looks[0], looks[1], looks[1], looks[2]]):
        for f in folder.iterdir():
            f.unlink()
        for n, text in files.items():
            (folder / n).write_text(text)
        number = min(number, 1) if number < 3 else 2
        told = {r["path"].rsplit("/", 1)[1]: r["action"] for r in follow.look(spark, str(folder), table, lambda lines: P.parse(lines, "keyvalue"), number).collect()}
        if number == 1:
            assert told == {"still": "idle", "grows": "reload" if files["grows"][: len(looks[0]["grows"])] != looks[0]["grows"] else "append", "turns": "reload", "new": "load", "goes": "drop"}
        got = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["Message"]) for r in follow.followed(spark, table).collect())
        whole = P.parse(L.read_folder(spark, str(folder)), "keyvalue").collect()
        assert got == sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["Message"]) for r in whole)
