"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import collocations as module
from tidelog.llm.collocations import HatTrie, collocations
from tests.llm.test_texts import LOWER, ODD


def brute(rows, longest=4, least=30, best=2000, covered=80):
    counts, total = {}, Counter()
    for text, lang in rows:
        held = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang or "und"] += len(w)
            held.update(w[i : i + k] for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        hidden = {p[i : i + m] for p, c in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * c >= covered * f[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in hidden:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def corpus(rng):
    phrases = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(2, 6))) for _ in range(12)] + ["Été\tà la", "X  y Z"]
    rows = []
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(phrases), f"w{rng.randint(0, 30)}"]) + rng.choice(["", "", ".", ", ", "\n", "\x0b", " ;"]) for _ in range(rng.randint(0, 20)))
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows + [(x, "en") for x in ODD] + [("same same " * 60, "fr")]


@pytest.mark.parametrize(("burst", "held", "best"), [(16_384, 400_000, 2000), (2, 40, 2000), (4, 300, 7)])
def test_against_brute_force(spark, monkeypatch, burst, held, best):
    rows = corpus(random.Random(burst))
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, f long").repartition(4)
    monkeypatch.setattr(module, "BURST", burst)
    monkeypatch.setattr(module, "HELD", held)
    got = collocations(df, best=best)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, best=best)
    assert len(want) > 20 and sorted(tuple(r[c] for c in names) for r in got.collect()) == want


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).count() == 0


def test_products_beyond_a_long(spark):
    from pyspark.sql import functions as F

    big = 3 * 10**14
    df = spark.createDataFrame([(big, big + 1, 7 * big)], "a long, l long, r long").select(*[F.col(c).cast("decimal(20,0)") for c in "alr"])
    got = df.select(module.whole_quotient(F.col("a") * F.lit(2_000_000).cast("decimal(7,0)"), F.col("l") + F.col("r")).alias("s")).first()["s"]
    assert got == 2_000_000 * big // (8 * big + 1)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_trie(monkeypatch, n):
    monkeypatch.setattr(module, "BURST", 5)
    rng = np.random.default_rng(n)
    trie, want, spilled = HatTrie(n), Counter(), Counter()
    for k in range(30):
        phrases, counts = np.unique(rng.integers(0, 6, (40, n)).astype(np.uint64), axis=0, return_counts=True)
        trie.add(phrases, counts)
        want.update(dict(zip(map(tuple, phrases.tolist()), counts.tolist(), strict=True)))
        assert trie.size == trie.entries(trie.root)
        for p, c in trie.spilled(20 if k < 29 else -1):
            assert p.tolist() == sorted(p.tolist())
            spilled.update(dict(zip(map(tuple, p.tolist()), c.tolist(), strict=True)))
        assert trie.size <= 20
    assert trie.size == 0 and spilled == want
