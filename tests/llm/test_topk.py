import math
import random

import pyspark.sql.functions as F
import pytest

from tidelog.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in {(i, tuple(v)) for i, v in good if i % 5 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in good if i != q and len(v) == len(u))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, [0.0] * 8), (305, [1.0] * 3), (306, [2.0] * 3), (310, None), (311, []), (312, [1.0, None] * 4), (313, [float("nan")] * 8), (314, [float("inf")] * 8)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.top_k(df, df.filter("vec_id % 5 = 0"), 6)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows, 6)


def test_components_and_scores_beyond_a_long(spark):
    rows = [(0, [1e300, -1.0]), (1, [1e300, 5.0]), (2, [2e300, 0.0]), (3, [-1e300, 0.0]), (4, [-2e300, 1.0]), (5, [0.0, 1.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0 and embedding[0] > 1e200"), 5).orderBy("rank").collect()
    top, low = 2**63 - 1, -(2**63)
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, top), (1, top), (5, -1024 * 1024), (3, low), (4, low)]


def test_query_rows_of_one_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0"), 1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 1, 2)]


def test_huge_components_and_empty(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 2.0]), (2, [3.0, 1e6])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id = 0"), 5).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, int(1e9) * 1024 * 3 * 1024 + 1024 * 1024 * 10**6), (1, int(1e9) * 1024 * 1024 + 1024 * 2048)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0
