"""MinHash near-dedup and its components against brute force."""

import random

import numpy as np
import pytest

from tidelog.llm import minhash
from tidelog.llm.components import star_components
from tidelog.llm.minhash import near_duplicates
from tests.llm.test_texts import ODD, prose, word_list


def shingles(text, n=4):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, shingles, component, kept) of documents with distinct ids."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d in sets)


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def corpus(rng):
    """Chains of edits, near copies on both sides of the limit, copies, odd texts."""
    rows, base = [], [prose(rng, rng.choice([5, 12, 60, 200]), 4000).split() for _ in range(12)]
    for w in base:
        for _ in range(12):
            w = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
            rows.append(" ".join(w))
    common = prose(rng, 50, 4000).split()
    for _ in range(40):  # one large group of which many link with few others
        rows.append(" ".join(x if rng.random() > 0.04 else f"odd{rng.randint(0, 9999)}" for x in common))
    rows += [rows[0]] * 30 + ODD
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [3, 2048])
def test_against_brute_force(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(random.Random(block))
    got = near_duplicates(make_docs(rows).withColumnRenamed("lang", "at").withColumnRenamed("source", "class"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == brute(rows)


def test_ids_and_empty_tables(spark, make_docs):
    text = prose(random.Random(4), 30)
    got = near_duplicates(make_docs([(5, text), (5, text), (3, text + " more"), (None, text), (None, None), (7, ""), (8, "a b"), (9, "A  b")])).collect()
    want = [("3", 3, True), ("5", 3, False), ("5", 3, False), ("7", 7, True), ("8", 8, True), ("9", 8, False), ("None", 3, False), ("None", None, True)]
    assert sorted(((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got), key=str) == want
    assert near_duplicates(make_docs([])).count() == 0


def test_signatures():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    t = np.concatenate([s[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # 800 of 1000
    sig = minhash.minima(np.concatenate([s, t]), np.array([0, len(s)]))
    assert (sig[0] == ((s * minhash._A[0] + minhash._B[0]) >> np.uint64(32)).min())[0]
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.15
    keys = minhash.band_keys(sig)
    for band in range(minhash.BANDS):
        own = slice(band * minhash.ROWS, (band + 1) * minhash.ROWS)
        assert (keys[0, band] == keys[1, band]) == (sig[0, own] == sig[1, own]).all()
    assert len(set(keys[0].tolist())) == minhash.BANDS


def test_recall_of_bands_at_the_limit():
    """The probability to share no band, and to agree in too few places, at a similarity of 0.8."""
    from math import comb

    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-7
    n = minhash.FUNCTIONS
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(minhash.AGREEING)) < 1e-6


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(50)] + [(99, 98)]])
def test_components(spark, edges):
    rng = random.Random(2)
    edges = edges + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] if len(edges) > 2 else edges
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:5]]], "a long, b long")
    assert {r["member"]: r["class"] for r in star_components(df).collect()} == label
