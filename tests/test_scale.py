"""What has to stay bounded as tables grow."""

import gc
import inspect
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from pyspark.sql import GroupedData

from tidelog.functions import severity as sev
from tidelog.operators import sinks, timeline
from tidelog.sources import annotations as A
from tests.test_queries import same
from tidelog.llm import language_id, pii
from tidelog.plans import queries
from tidelog.plans import rendered as R
from tidelog.sources import lines as L
from tidelog.sources import ranges


def test_sidecars_are_files_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FOLDERS", 4)
    files = spark.range(50).select(F.col("id").alias("file_id"), F.concat(F.lit("é"), "id").alias("name"), (F.col("id") * 10).alias("size"), F.lit("ab").alias("prefix_sha256"), F.lit(3).alias("prefix_length"))
    notes = spark.createDataFrame([], "file_id long, id string, start_line long, end_line long, note string, color string, tag string, author string, created_at timestamp, modified_at timestamp, anchor_hash string, snippet string")
    sinks.write_annotations(notes, files, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").iterdir())) <= 4 and len(list((tmp_path / "s").glob("*/*.notes.json"))) == 50
    _, rejected, read = A.read_annotations(spark, f"file:{tmp_path}/s")
    assert rejected.count() == 0 and {(r["name"], r["size"]) for r in read.collect()} == {(f"é{i}", 10 * i) for i in range(50)}


def test_small_rows_of_large_work_are_not_merged(spark):
    assert ranges.dealt(spark.range(8), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_first_rows_at_times_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.randrange(3), i) for i in range(60)]
    asked = list(range(-5, 60))
    got = timeline.first_rows_at_times(spark.createDataFrame(rows, "ts_ms long, file_id long, line_no long"), spark.createDataFrame([(t,) for t in asked], "t_ms long"), 10)
    want = {t: min((r for r in rows if r[0] >= t), default=(None, None, None)) for t in asked}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    frames = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "windowspecdefinition" in line]
    assert frames and not any("unboundedfollowing" in line for line in frames)  # a frame that shrinks is gone through for every row


def test_numbers_of_texts(spark):
    texts = ["", " 12 ", "x", "-7", "+3", "1.5", ".5", "1e3", "abc1", "\t4\n", None, "99999999999999999999", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("int", "bigint", "decimal(38,9)"):
        assert df.filter(~sev.number_of(F.col("t"), kind).eqNullSafe(F.col("t").try_cast(kind))).count() == 0, kind


def test_numbers_and_offsets_go_on_from_file_to_file_of_a_log(spark, tmp_path):
    texts = {"a-0.txt": "x\nyé\n", "a-1.txt": "\r\nlast\n" * 400, "b-0.txt": "z\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    log = F.regexp_extract("path", "([ab])-", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = L.read_folder(spark, str(tmp_path), ("*.txt",), log, offsets=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for which, names in (("a", ["a-0.txt", "a-1.txt"]), ("b", ["b-0.txt"])):
        whole = "".join(texts[n] for n in names).encode().split(b"\n")[:-1]
        want = [(i, sum(len(x) + 1 for x in whole[:i]), x.removesuffix(b"\r").decode()) for i, x in enumerate(whole)]
        assert sorted((r["line_no"], r["byte_offset"], r["raw"]) for r in got if f"/{which}-" in r["path"]) == want


def test_a_log_is_cut_into_files_as_it_grows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "SEGMENT", 4096)
    path = queries.written_files(spark, sf_dir)
    assert queries.listed_logs(spark, path).count() > 40
    for name in ("line_numbers", "line_offsets", "match_files", "file_identity", "grep_errors", "grep_sound", "read_gzip", "read_folder", "read_lines"):
        same(spark, sf_dir, name)


def test_followed_logs_go_on_in_files_of_bounded_size(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROLLED", 30)
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    same(spark, sf_dir, "follow_folder")
    files = {f"{p.parent.name}/{p.name}": p.read_text() for p in tmp_path.glob("logs/*/*.log")}
    assert len(files) > 20 and max(t.count("\n") for t in files.values()) == 30 and not any(f.startswith("3/") for f in files)


@pytest.mark.parametrize("rows", [1, 3, 10000])
def test_lines_are_written_as_files(spark, tmp_path, rows):
    want = {f"{tmp_path}/{f}/a.log": [f"{f} é{i}" * (i % 3) for i in range(f + 1)] for f in range(7)}
    lines = spark.createDataFrame([(p, i, x, len(own) % 2 == 0) for p, own in want.items() for i, x in reversed(list(enumerate(own)))], "path string, n long, raw string, ended boolean")
    for _ in range(2):  # over what is there
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            ranges.write_lines(lines, "n")
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path, own in want.items():
        with open(path, newline="") as f:
            assert f.read() == "\n".join(own) + ("\n" if len(own) % 2 == 0 else "")


def test_a_file_is_parsed_by_its_own_format_only(spark, sf_dir):
    files = {r["file_id"] for r in R.parsed(spark, sf_dir, "logcat", "file_id >= 2").select("file_id").distinct().collect()}
    assert files == {2, 3, 4}
    same(spark, sf_dir, "timeline_merge")


def test_trees_are_fitted_on_all_examples():
    assert inspect.signature(pii.fit_pii_model).parameters["max_candidates"].default is None


def test_a_duel_is_fitted_in_one_copy():
    rng = np.random.default_rng(5)
    x = (rng.random((4000, 512)) * np.linspace(0, 9, 512)).astype(np.float32)
    y = np.where(x[:, 7] + x[:, 300] > 3, 1.0, -1.0).astype(np.float32)
    tracemalloc.start()
    w, bias = language_id.squared_hinge(x, y, 0.01, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes
    assert ((x @ w + bias > 0) == (y > 0)).mean() > 0.8


def most_held(work) -> int:
    """Bytes that numpy and Arrow hold at once while ``work`` yields."""
    gc.collect()
    before, arrow = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for _ in work:
        arrow = max(arrow, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak + arrow


def test_language_workers_hold_a_slice_and_one_copy_of_a_duel(spark, monkeypatch):
    """What the tasks run is called here, where its memory can be read."""
    passes = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: passes.append(f) or self.sparkSession.createDataFrame([], schema))
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: passes.append(f) or self._df.sparkSession.createDataFrame([], schema))
    docs = spark.createDataFrame([(1, "ein Satz", "de"), (2, "a phrase", "en")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs)
    language_id.with_language(docs, model)
    features, fit, predict = passes
    rng = np.random.default_rng(3)
    texts = pa.array(["".join(chr(97 + c) for c in rng.integers(0, 14, 500)) for _ in range(6000)])
    langs = pa.array(["de", "en"] * 3000)
    assert most_held(features(iter([pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"])]))) < 40e6
    part = pa.Table.from_batches(list(features(iter([pa.RecordBatch.from_arrays([langs, texts], ["lang", "text"])])))).drop_columns(["lang"])
    for name in ("a", "b", "team"):
        part = part.append_column(name, pa.array([name] * part.num_rows))
    part = part.append_column("first", pa.array([True, False] * 3000))
    assert part.nbytes + most_held(fit(x) for x in [part]) < 1.5 * part.num_rows * language_id.BUCKETS * 4
    columns = [pa.array(range(6000)), texts, langs, pa.array([True] * 6000)]
    assert most_held(predict(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang", "_letters"])]))) < 20e6
