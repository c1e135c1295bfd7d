"""Phrase collocation mining: exact counts of word phrases from HAT-tries, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and these into words; everything is per
language. Phrases of one word are counted first, then those of two, three and so on: a phrase can be frequent only if
both phrases without its first and without its last word are, so every pass counts the phrases that a bitmap of the
frequent ones of the pass before lets through. The bitmap has a fixed size; what passes it by accident is counted too
and falls out by its count, so no frequent phrase is lost and no count depends on it.

A task counts in a HAT-trie: a shallow trie over the bytes of the first word's id, under which hash containers hold
phrases and their counts. A container that grows beyond BURST entries bursts into one per next byte. Beyond HELD entries the task
spills its largest subtrees as sorted runs, packed by the first bits of the phrases' hashes: by the whole phrase, not by
its first word, which may be that of a third of all phrases. The runs of a part are merged together; there are as many
parts as the corpus needs for each to stay small.

Word ids are 64-bit hashes of language and word; two frequent words of a corpus share one with a probability of some
10^-7. Phrases are told apart by their words' ids.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each; an empty table gives an empty
result. Arithmetic is exact, in decimals where products may pass 64 bits. Ties in score and count go by the phrase's
bytes. Columns other than text and language are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tidelog.llm import words
from tidelog.llm.common import stored
from tidelog.llm.decontaminate import seed_filter

#: Entries of a container before it bursts, and of a task's trie before it spills.
BURST, HELD = 16_384, 400_000
#: Words of the corpus for one part of the phrases, which is merged at once: no phrase has more occurrences than that.
PART_WORDS = 400_000
#: Bytes that end a piece, and those that end a word.
_ENDS_PIECE = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
_ENDS_WORD = _ENDS_PIECE | np.isin(np.arange(256), [9, 32])
UNKNOWN = "und"


class Node:
    """``below``: counts by phrase, or, once burst, nodes by the next byte of the first word's id."""

    __slots__ = ("below", "burst")

    def __init__(self) -> None:
        self.below: dict = {}
        self.burst = False


class HatTrie:
    """Counts of phrases of ``n`` word ids; the path to a container are the first bytes of the first word's id."""

    def __init__(self, n: int) -> None:
        self.n, self.root, self.size = n, Node(), 0

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct ``phrases`` (a row each), sorted."""
        keys = phrases[:, 0].tolist() if self.n == 1 else np.ascontiguousarray(phrases).view(f"V{8 * self.n}").ravel().tolist()
        counts = counts.tolist()
        work = [(self.root, 0, 0, len(keys))]
        while work:
            node, depth, a, b = work.pop()
            held = node.below
            if node.burst:
                digit = (phrases[a:b, 0] >> np.uint64(56 - 8 * depth)) & np.uint64(255)
                firsts = [a, *(np.flatnonzero(digit[1:] != digit[:-1]) + 1 + a).tolist()]
                for x, y in zip(firsts, [*firsts[1:], b], strict=True):
                    work.append((held.setdefault(int(digit[x - a]), Node()), depth + 1, x, y))
                continue
            self.size -= len(held)
            get = held.get
            for key, c in zip(keys[a:b], counts[a:b], strict=True):
                held[key] = get(key, 0) + c
            self.size += len(held)
            if len(held) > BURST and depth < 8:
                self.open(node, depth)

    def open(self, node: Node, depth: int) -> None:
        """Burst a container into one per next byte."""
        held, node.below, node.burst = node.below, {}, True
        for key, c in held.items():
            first = key if self.n == 1 else int.from_bytes(key[:8], "little")
            node.below.setdefault(first >> (56 - 8 * depth) & 255, Node()).below[key] = c

    def entries(self, node: Node) -> int:
        return sum(map(self.entries, node.below.values())) if node.burst else len(node.below)

    def run(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, counts) of a subtree, sorted."""
        containers, work = [], [node]
        while work:
            node = work.pop()
            if node.burst:
                work += node.below.values()
            else:
                containers.append(node.below)
        total = sum(map(len, containers))
        keys = chain.from_iterable(containers)
        phrases = (np.fromiter(keys, np.uint64, total) if self.n == 1 else np.frombuffer(b"".join(keys), np.uint64)).reshape(-1, self.n)
        counts = np.fromiter(chain.from_iterable(x.values() for x in containers), np.int64, total)
        order = np.lexsort(phrases.T[::-1])
        return phrases[order], counts[order]

    def spilled(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees, which leave the trie, until it holds that many entries at most."""
        if not self.root.burst:
            if self.size > down_to:
                yield self.run(self.root)
                self.root, self.size = Node(), 0
            return
        sizes = sorted(((self.entries(child), digit) for digit, child in self.root.below.items()), reverse=True)
        away, gone = Node(), 0
        away.burst = True
        while gone < len(sizes) and self.size > down_to:
            n, digit = sizes[gone]
            away.below[digit] = self.root.below.pop(digit)
            self.size -= n
            gone += 1
        if gone:
            yield self.run(away)


def phrase_words(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, salts: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each word, number of its piece, index of its text) of texts in one buffer."""
    h, owner = words.word_hashes(data, offsets, _ENDS_WORD)
    languages = part.column("lang").to_pylist()
    for name in set(languages) - set(salts):
        salts[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
    of_text = np.array([salts[name] for name in languages], np.uint64)
    ids = words.mixed(h + of_text[owner])
    return ids, np.cumsum(_ENDS_PIECE[data])[word_starts(data, offsets)] + owner, owner


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = ~_ENDS_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    start[edges] |= inside[edges]
    return np.flatnonzero(start)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one, number) of each distinct value."""
    order = np.argsort(h)
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, np.int64)
    return order[first], np.diff(first, append=len(h))


def word_runs(docs: DataFrame) -> DataFrame:
    """``w1``, ``lang``, ``word`` and ``c``: counts of the words that tasks saw."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, salts, kinds = HatTrie(1), {}, {}, []
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text"):
                ids, _, owner = phrase_words(part, data, offsets, salts)
                at, c = distinct(ids)
                order = np.argsort(ids[at])
                at, c = at[order], c[order]
                starts, languages = word_starts(data, offsets), part.column("lang").to_pylist()
                ends = np.append(np.flatnonzero(_ENDS_WORD[data]), len(data))
                ends = np.minimum(ends[np.searchsorted(ends, starts[at])], offsets[owner[at] + 1])
                raw = words._LOWER[data].tobytes()
                kinds += sorted(set(salts) - set(kinds))
                number = [kinds.index(name).to_bytes(4, "little") for name in languages]
                for i, x, y, o in zip(ids[at].tolist(), starts[at].tolist(), ends.tolist(), owner[at].tolist(), strict=True):
                    if i not in names:
                        names[i] = number[o] + raw[x:y]
                trie.add(ids[at][:, None], c)
                if trie.size > HELD:
                    yield from told(trie, 0, names, kinds)
        yield from told(trie, -1, names, kinds)

    def told(trie: HatTrie, down_to: int, names: dict, kinds: list) -> Iterator[pa.RecordBatch]:
        for phrases, counts in trie.spilled(down_to):
            for a in range(0, len(counts), 1 << 16):
                ids = phrases[a : a + (1 << 16), 0]
                own = [names.pop(i) for i in ids.tolist()]
                lang, word = [kinds[int.from_bytes(x[:4], "little")] for x in own], [x[4:].decode("utf-8", "replace") for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(counts[a : a + (1 << 16)])], ["w1", "lang", "word", "c"])

    return docs.mapInArrow(rows, "w1 long, lang string, word string, c long")


def phrase_runs(docs: DataFrame, n: int, frequent: words.HashFilter, bits: int) -> DataFrame:
    """Sorted runs of the phrases of ``n`` > 1 words both whose shorter phrases are ``frequent``: ``part``, the first ``bits``
    of the phrases' hashes, their ``ids`` and their ``counts`` as the task saw them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, salts = HatTrie(n), {}
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text"):
                ids, piece, _ = phrase_words(part, data, offsets, salts)
                m = len(ids) - n + 1
                if m <= 0:
                    continue
                shorter = frequent.passing(joined(ids, n - 1))
                at = np.flatnonzero(shorter[:-1] & shorter[1:] & (piece[:m] == piece[n - 1 :]))
                some, c = distinct(joined(ids, n)[at])
                phrases = ids[at[some][:, None] + np.arange(n)]
                order = np.lexsort(phrases.T[::-1])
                trie.add(phrases[order], c[order])
                if trie.size > HELD:
                    yield from told(trie, HELD // 2)
        yield from told(trie, -1)

    def told(trie: HatTrie, down_to: int) -> Iterator[pa.RecordBatch]:
        for phrases, counts in trie.spilled(down_to):
            if not len(counts):
                continue
            part = (joined(phrases.ravel(), n)[::n] >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, phrases, counts = part[order], phrases[order], counts[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            pieces = list(zip(cuts, [*cuts[1:], len(part)], strict=True))
            raw = [pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (phrases, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *raw], ["part", "ids", "counts"])

    return docs.mapInArrow(rows, "part int, ids binary, counts binary")


def merged_runs(runs: DataFrame, n: int, least: int) -> DataFrame:
    """``w1`` to ``w<n>`` and ``f`` of the phrases that occur ``least`` times in all runs of their part."""
    names = [f"w{k}" for k in range(1, n + 1)]

    def merge(part: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.uint64).reshape(-1, n)
        counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.int64)
        order = np.lexsort(ids.T[::-1])
        ids = ids[order]
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
        f = np.add.reduceat(counts[order], first)
        ids, f = ids[first[f >= least]], f[f >= least]
        return pa.table([*(pa.array(np.ascontiguousarray(ids[:, k]).view(np.int64)) for k in range(n)), pa.array(f)], names=[*names, "f"])

    return runs.groupBy("part").applyInArrow(merge, "".join(f"{c} long, " for c in names) + "f long")


def joined(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n word ids, whatever pieces they are in."""
    if n == 1:
        return ids
    return words.ngram_hashes(ids, np.zeros(len(ids), np.int64), n)[0]


def phrase_counts(docs: DataFrame, longest: int, least: int, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(words: ``w1``, ``lang``, ``word``, ``f``, all; phrases: ``p``, an array of word ids, ``f``, those of ``least`` or more)."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    vocabulary = stored(word_runs(rows).groupBy("w1", "lang", "word").agg(F.sum("c").alias("f")), "words")
    frequent = vocabulary.filter(F.col("f") >= least).select("w1", "f")
    found = [frequent.select(F.array("w1").alias("p"), "f")]
    total = vocabulary.agg(F.sum("f")).first()[0] or 0
    bits = min(20, max(4, (total // PART_WORDS).bit_length()))
    for n in range(2, longest + 1):
        names = [f"w{k}" for k in range(1, n + 1)]
        passing = seed_filter(hashed(frequent, n - 1))
        frequent = stored(merged_runs(phrase_runs(rows, n, passing, bits), n, least), f"phrases-{n}")
        found.append(frequent.select(F.array(*names).alias("p"), "f"))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.union(more)
    return vocabulary, phrases


def hashed(phrases: DataFrame, n: int) -> DataFrame:
    """``gram``: the hash of each row of ``w1`` to ``w<n>``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([np.asarray(batch.column(f"w{k}")) for k in range(1, n + 1)], 1).view(np.uint64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(joined(ids, n)[::n].view(np.int64))], ["gram"])

    return phrases.mapInArrow(rows, "gram long")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, best: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``best`` phrases of 2 to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, the one with the lowest score
    floor(2000000 a / (l + r)), ``n`` all words of the language. Phrases that occur ``least`` times are candidates; one
    inside a longer candidate that has ``covered`` hundredths of its count is left out.
    """
    vocabulary, phrases = phrase_counts(docs, longest, least, text, lang)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    size = F.size("p")
    candidates = phrases.filter(size > 1).withColumnRenamed("f", "a")
    # every contiguous part of a frequent phrase is frequent, so both parts of a cut are found
    cut = lambda k: F.struct(k.alias("k"), F.slice("p", F.lit(1), k).alias("first"), F.slice("p", k + 1, size - k).alias("rest"))
    cuts = candidates.select("p", "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), cut)).alias("c")).select("p", "a", "c.*")
    cuts = cuts.join(phrases.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(phrases.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.withColumn("score", whole_quotient(big("a") * F.lit(2_000_000).cast("decimal(7,0)"), big("l") + big("r")))
    scored = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("p", "a", "c.l", "c.r", "c.score")
    # candidates inside longer ones: the largest count of these
    inner = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("p", i, m))
    parts = candidates.filter(size > 2).select("a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), inner))).alias("p"))
    longer = parts.groupBy("p").agg(F.max("a").alias("_longer"))
    hundred = F.lit(100).cast("decimal(3,0)")
    kept = scored.join(longer, "p", "left").filter(F.col("_longer").isNull() | (big("_longer") * hundred < big("a") * F.lit(covered).cast("decimal(3,0)")))
    names = vocabulary.select("w1", "lang", "word")
    kept = kept.withColumn("w1", F.element_at("p", 1)).join(names.drop("word"), "w1")
    order = [F.col("score").desc(), F.col("a").desc()]
    first = kept.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_r") <= best).drop("_r", "w1")
    first = stored(first, "collocations")
    spelt = first.select("p", F.posexplode("p").alias("i", "w1")).join(names.drop("lang"), "w1").groupBy("p").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "word"))).word, " ").alias("phrase"))
    total = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    out = first.join(spelt, "p").join(total, "lang")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= best)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").withColumns({c: F.col(c).cast("long") for c in ("rank", "a", "l", "r", "n", "score")})


def whole_quotient(x: Column, y: Column) -> Column:
    """The whole part of the quotient of two positive decimals."""
    return F.call_function("div", x, y)
