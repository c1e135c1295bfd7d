"""Hard negatives and their interval bounds against brute force."""

import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from tidelog.llm import hard_negatives as module
from tidelog.llm.hard_negatives import Asked, coded, directions, hard_negatives, rotated


def brute(rows, chosen, scale=256):
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u, own in {(i, tuple(v), label) for i, v, label in good if i in chosen}:
        scored = [(-sum(a * b for a, b in zip(u, v, strict=True)), i, label) for i, v, label in good if len(v) == len(u)]
        positives = sorted((s, i) for s, i, label in scored if label == own and i != q)[:5]
        for p, i in positives:
            fit = sorted((s, j) for s, j, label in scored if label != own and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(q, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<double>, label int"


def mined(spark, rows, chosen):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("score", F.lit("x"))
    return sorted(tuple(r[c] for c in NAMES) for r in hard_negatives(df, df.filter(F.col("vec_id").isin(*chosen))).collect())


@pytest.mark.parametrize(("block", "dims"), [(16, 5), (8192, 20), (50, 70)])
def test_against_brute_force(spark, monkeypatch, block, dims):
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.6) for x in rng.choice(centres)], rng.randint(0, 3)) for i in range(160)]
    rows += [(300 + i, rows[i][1], rng.randint(0, 3)) for i in range(20)] + [(400, [0.0] * dims, 1), (401, [1.0] * 3, 1), (402, [2.0] * 3, 1), (403, [1.5] * 3, 2)]
    rows += [(410, None, 1), (411, [], 1), (412, [1.0, None] * dims, 1), (413, [float("nan")] * dims, 1), (414, [float("inf")] * dims, 1), (415, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [rows[5], rows[5]]
    chosen = [*range(0, 160, 8), 305, 400, 401, 410, 415]
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "TEAM", block)
    want = brute(rows, chosen)
    assert len(want) > 100 and mined(spark, rows, chosen) == want


def test_scores_of_any_size(spark):
    big = 10.0**12
    rows = [(0, [big, 1.0], 0), (1, [big, 0.0], 0), (2, [0.7 * big, 5.0], 1), (3, [0.94 * big, 0.0], 1), (4, [-big, 0.0], 1), (5, [big, 1.0], 1), (6, [0.0, 1.0], 0)]
    top = 2**63 - 1
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df, df.filter("vec_id = 0"), positives=1).orderBy("rank").collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == [(0, 1, 1, 3, top, top), (0, 1, 2, 2, top, top)]


def test_empty(spark):
    assert mined(spark, [], [1]) == [] and mined(spark, [(1, [1.0], 1)], [1]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], [1]) == []


def test_intervals_hold():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 24)) * 100, np.zeros((1, 24))]).astype(np.int64)
    unit, lengths = directions(x)
    assert unit.shape == (301, 64) and np.allclose(unit[:, :24] * lengths[:, None], x)
    assert np.allclose(rotated(unit, 1) @ rotated(unit, 1).T, unit @ unit.T)
    codes, aligned, left = coded(unit)
    widths = []
    for a in range(20):
        asked, middle = Asked(unit[:20]), 0
        for level in range(module.LEVELS):
            estimate, width = asked.bounds(a, level, codes[level], aligned[level], left[level])
            middle = middle + estimate
            assert (np.abs(unit @ unit[a] - middle) <= width + 1e-9).all()
            widths.append(np.median(width))
    assert widths[module.LEVELS - 1] < 0.25 < widths[0]
