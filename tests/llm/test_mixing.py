import math
from collections import Counter
from fractions import Fraction

import pytest

from tidelog.llm.mixing import mixed_order, schedule, target_weights


def edf(weights, blocks):
    """Earliest deadline first, block by block, in exact fractions: (source, block, slot)."""
    total = sum(weights.values())
    share = {s: Fraction(w, total) for s, w in weights.items()}
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    got, slot, out = Counter(), 0, []
    while left := [s for s in names if got[s] < blocks[s]]:
        slot = max(slot, min(math.floor(got[s] / share[s]) for s in left))
        free = [(math.ceil((got[s] + 1) / share[s]), names.index(s), s) for s in left if math.floor(got[s] / share[s]) <= slot]
        s = min(free)[2]
        out.append((s, got[s], slot))
        got[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 90}, {None: 50, "x": 7, "y": 300}, {"only": 7}])
def test_schedule_is_edf(spark, sizes):
    counts = spark.createDataFrame(list(sizes.items()), "source string, n long")
    weights = target_weights(counts)
    given = {r["source"]: r["w"] for r in weights.collect()}
    got = schedule(weights, 4).orderBy("slot").collect()
    assert [(r["source"], r["block"], r["slot"]) for r in got] == edf(given, {s: -(-n // 4) for s, n in sizes.items()})


def test_deviation_from_the_target_stays_below_a_block(spark):
    target = {"a": 1.0, "b": 1e-6, "c": 0.3333, "d": 0.1}
    sizes = {"a": 69_000, "b": 2, "c": 23_100, "d": 7_000}
    weights = target_weights(spark.createDataFrame(list(sizes.items()), "source string, n long"), target)
    rows = schedule(weights, 1).orderBy("slot").collect()
    assert len(rows) == sum(sizes.values()) and len({r["slot"] for r in rows}) == len(rows)
    total, got = sum(target.values()), Counter()
    for r in rows:
        if r["slot"] >= 60_000:
            break  # later some sources have run out
        got[r["source"]] += 1
        assert all(abs(got[s] - (r["slot"] + 1) * w / total) < 1 + 1e-4 for s, w in target.items())
    assert got.total() == 60_000 and got["b"] <= 1  # no slot is left empty while all have blocks


def test_many_sources(spark):
    counts = spark.createDataFrame([(f"s{i}", 3) for i in range(1500)], "source string, n long")
    assert schedule(target_weights(counts), 2).count() == 3000


def test_given_weights(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, n long")
    got = {r["source"]: r["w"] for r in target_weights(counts, {"a": 1, "b": 1, "c": 2}).collect()}
    assert got["c"] == 2 * got["a"] == 2 * got["b"]
    with pytest.raises(ValueError):
        target_weights(counts, {"a": 0})
    with pytest.raises(Exception, match="no weight"):
        target_weights(counts, {"a": 1}).collect()


def brute_positions(rows, size, weights):
    """Slot of each (source, block), from the sizes alone."""
    sizes = Counter(r[3] for r in rows)
    return {(s, k): slot for s, k, slot in edf(weights, {s: -(-n // size) for s, n in sizes.items()})}


def test_all_rows_once_hot_source(spark, make_docs):
    rows = [(i, "t", "en", "hot" if i % 3 else ("b", "c", None)[i % 9 // 3]) for i in range(3000)] + [(0, "t", "en", "b"), (None, "t", "en", None), (None, "t", "en", None)]
    docs = make_docs(rows).withColumnRenamed("n_chars", "slot").withColumnRenamed("text", "k").withColumnRenamed("lang", "in_period")
    got = mixed_order(docs, block_rows=16).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert got[0]["k"] == "t" and got[0]["in_period"] == "en"
    assert len({r["position"] for r in got}) == len(rows)
    counts = spark.createDataFrame(list(Counter(r[3] for r in rows).items()), "source string, n long")
    slots = brute_positions(rows, 16, {r["source"]: r["w"] for r in target_weights(counts).collect()})
    for r in got:
        assert r["slot"] == slots[r["source"], r["block"]] and r["position"] == 16 * r["slot"] + r["place"]
    full = Counter((r["source"], r["block"]) for r in got)
    assert all(n == 16 or b == max(x for s2, x in full if s2 == s) for (s, b), n in full.items())


def test_blocks_grow_beyond_their_number(make_docs, monkeypatch):
    monkeypatch.setattr("tidelog.llm.mixing.MAX_BLOCKS", 8)
    got = mixed_order(make_docs([(i, "t", "en", f"s{i % 2}") for i in range(2000)])).collect()
    assert len({r["slot"] for r in got}) == 8 and len({r["position"] for r in got}) == 2000


def test_empty(make_docs):
    assert mixed_order(make_docs([])).count() == 0
