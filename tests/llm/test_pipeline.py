import random

import corpus_pipeline
from tests.llm.test_texts import prose


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 40, 3000)
    rows = [(i, prose(rng, 60, 3000), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1"), (101, rows[1][1] + " more", "en", "s1"), (102, f"x {item} y", "en", "s0"), (103, None, "en", "s0"), (104, "12 34", "de", None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows} - {103, 104}
    assert kept[1] == kept[0] - {100, 101}
    assert kept[2] == kept[3] == kept[4] == kept[1] - {102}
    starts = sorted((r["start"], r["n_tokens"]) for r in docs.collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_tokens_follow_the_mixed_order(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"word{i}", "en", f"s{i % 4}") for i in range(200)])
    corpus_pipeline.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = [r["doc_id"] for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = corpus_pipeline.tokens(spark, mixed, "").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == order and order != sorted(order)


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= docs.count()
