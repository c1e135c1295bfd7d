"""MinHash near-dedup: minima of universal hashes in bands, signature verification, exact confirmation, components.

A document's set is that of its distinct runs of four words. Its signature holds the minima of FUNCTIONS hashes
a * x + b modulo 2^64; documents whose minima agree in all places of a band meet in that band's bucket. Sets that link
(Jaccard similarity of 0.8 or more) miss each other in all BANDS bands with a probability below 10^-7.

Equal sets collapse to one member before anything meets. A bucket is worked on in two rounds, and neither makes its
pairs:

* Every member meets the least member of its bucket; of these partners the one whose signature agrees most is
  confirmed on the full sets, read again from the texts. The links give a first set of classes.
* Buckets that still hold several classes are complete: all members outside the bucket's largest class meet all members
  of other classes, in blocks of bounded size within tasks. Signatures that agree too little end a pair (a link is lost
  so with a probability below 10^-6); only members that have a partner left get their texts, for the exact count. A pair
  is counted in the first band that it shares. What leaves the tasks are links.

So a group of copies or near copies costs a row per member and band; a link between different texts is kept, whatever
bucket it is in. Classes are the connected components, by large-star and small-star.

Defined results: A-Z lower-cased words; with one to three words the whole sequence is the one shingle; without words
or text a document is empty, linked with nothing and its own component (n_shingles 0). Rows with equal or null ids are
documents of their own; a null id is a class's smallest only where all are null. ``kept`` is whether the id is the
component's. Shingles are 64-bit hashes, equal sets are told by a 128-bit digest. Columns other than id and text are
not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.llm import words
from tidelog.llm.common import placed, stored
from tidelog.llm.components import star_components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 4
FUNCTIONS = BANDS * ROWS
#: Minima that signatures of linked sets share at least: 102 are expected at 0.8, with a deviation of 4.5.
AGREEING = 78
#: Members, and shingles in all of them, of one block of a bucket.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
_RNG = np.random.default_rng(23)
_A = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
PLACE = ["key", "i", "j", "probe", "at", "n", "class", "own"]
_SALTS = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], np.uint64)


def minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A signature (uint32) per set; the sets' hashes ``h`` begin at ``starts`` and none is empty."""
    out = np.empty((FUNCTIONS, len(starts)), np.uint32)
    value = np.empty_like(h)
    for k in range(FUNCTIONS):
        np.multiply(h, _A[k], out=value)
        value += _B[k]
        out[k] = np.minimum.reduceat(value, starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """The buckets of each signature, one per band."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signatures), 1))
    for j in range(ROWS):
        keys = words.mixed(keys * words._STEP + signatures[:, j::ROWS].astype(np.uint64) + np.uint64(1))
    return keys


def signed(rows: DataFrame) -> DataFrame:
    """``at``, ``n`` shingles, the set's digest ``k1``, ``k2``, ``sig`` and the ``keys`` of its buckets, of ``at``, ``text``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text"):
                sets = words.shingle_sets(data, offsets, SHINGLE)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests = np.zeros((2, len(sets)), np.uint64)
                sig = np.zeros((0, FUNCTIONS), np.uint32)
                if len(full):
                    h = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for d, salt in zip(digests, _SALTS, strict=True):
                        d[full] = np.bitwise_xor.reduceat(words.mixed(h + salt), starts)
                    sig = minima(h, starts)
                taken = np.concatenate([[0], np.cumsum(sizes > 0)])
                raw = sig.tobytes()
                each = [raw[a * 4 * FUNCTIONS : b * 4 * FUNCTIONS] for a, b in zip(taken[:-1].tolist(), taken[1:].tolist(), strict=True)]
                keys = pa.ListArray.from_arrays(pa.array((taken * BANDS).astype(np.int32)), pa.array(band_keys(sig).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("at"), pa.array(sizes), *(pa.array(d.view(np.int64)) for d in digests), pa.array(each, pa.binary()), keys], ["at", "n", "k1", "k2", "sig", "keys"])

    return rows.select("at", "text").mapInArrow(sign, "at long, n long, k1 long, k2 long, sig binary, keys array<long>")


def similar_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def links(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.sort(np.concatenate([s, t]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(s) + len(t) - common)


def column_sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [s for _, data, offsets in words.slices(batch, column) for s in words.shingle_sets(data, offsets, SHINGLE)]


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, FUNCTIONS) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).sum(1).astype(np.int32))], ["a", "b", "agree"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [links(s, t) for s, t in zip(column_sets(batch, "s"), column_sets(batch, "t"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def head_links(entries: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """``a``, ``b``: members that link with the least member of a bucket of theirs, for each the one most like it."""
    pairs = entries.filter((F.col("at") != F.col("head.at")) & similar_size(F.col("n"), F.col("head.n"))).select(F.col("at").alias("a"), F.col("head.at").alias("b")).distinct()
    x, y = (members.select(F.col("at").alias(k), F.col("sig").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    told = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_agreement, "a long, b long, agree int")
    best = stored(told.filter(F.col("agree") >= AGREEING).groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")), "head-pairs")
    s, t = (rows.select(F.col("at").alias(k), F.col("text").alias(c)) for k, c in (("a", "s"), ("b", "t")))
    return stored(best.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(_confirmed, "a long, b long"), "links")


def in_blocks(entries: DataFrame) -> DataFrame:
    """The ``entries`` (key, at, n, class) of buckets with several classes, dealt into pairs of blocks.

    ``probe`` is set on the copies that stand for a member outside the bucket's largest class; in a pair of blocks
    (``key``, ``i``, ``j``) its members meet the others. Numbers of blocks follow from a bucket's size.
    """
    largest = entries.groupBy("key", "class").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    own = F.max_by(F.struct("class", "c", "s"), F.struct("c", "class"))
    buckets = largest.groupBy("key").agg(own.alias("own"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("key", F.col("own.class").alias("own"), blocks(F.col("c"), F.col("s")).alias("ni"), blocks(F.col("c") - F.col("own.c"), F.col("s") - F.col("own.s")).alias("nj"))
    met = entries.join(buckets, "key")
    i, j = (F.pmod(F.xxhash64("at", F.lit(k)), c).cast("int") for k, c in enumerate(("ni", "nj")))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda probe, i, j: met.select("key", i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"), "at", "n", "class", "own")
    return dealt(False, i, to("nj")).union(dealt(True, to("ni"), j).filter(F.col("class") != F.col("own")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of blocks at a time, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([np.asarray(batch.column(c), np.int64) for c in ("key", "i", "j")])
        cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        bounds = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and any(held[-1].column(c)[0] != batch.column(c)[a] for c in ("key", "i", "j")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _met(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(probes, others): the rows of the pairs of a block pair that may link and share no earlier band."""
    probe = np.asarray(block.column("probe").combine_chunks().cast(pa.int8()), np.int8).astype(bool)
    sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
    kind, n, at = (np.asarray(block.column(c).combine_chunks()) for c in ("class", "n", "at"))
    main = int(block.column("own")[0].as_py())
    key = int(block.column("key")[0].as_py())
    others = np.flatnonzero(~probe)
    out = [[], []]
    for p in np.flatnonzero(probe).tolist():
        # two probes meet once, in the order of their rows
        some = others[(kind[others] != kind[p]) & ((kind[others] == main) | (at[others] > at[p])) & (100 * np.minimum(n[others], n[p]) >= PERCENT * np.maximum(n[others], n[p]))]
        if not len(some):
            continue
        same = sig[some] == sig[p]
        agree = same.sum(1) >= AGREEING
        some, same = some[agree], same[agree]
        if len(some):
            first = same.reshape(len(some), BANDS, ROWS).all(2).argmax(1)
            some = some[band_keys(sig[p : p + 1])[0].view(np.int64)[first] == key]
            out[0].append(np.full(len(some), p))
            out[1].append(some)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        p, q = _met(block)
        left = np.union1d(p, q)
        if len(left):
            yield from block.take(pa.array(left)).select(PLACE).combine_chunks().to_batches()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        p, q = _met(block)
        at = np.asarray(block.column("at").combine_chunks())
        sets = [s for batch in block.to_batches() for s in column_sets(batch, "text")]
        ok = [links(sets[a], sets[b]) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        if any(ok):
            ok = np.array(ok)
            yield pa.RecordBatch.from_arrays([pa.array(at[p[ok]]), pa.array(at[q[ok]])], ["a", "b"])


def block_links(entries: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """``a``, ``b``: all links between members of different classes that share a bucket."""
    by = PLACE[:3]
    sig = members.select("at", "sig")
    near = stored(in_blocks(entries).join(sig, "at").repartition(*by).sortWithinPartitions(*by).mapInArrow(_with_partners, "key long, i int, j int, probe boolean, at long, n long, class long, own long"), "near")
    full = near.join(sig, "at").join(rows.select("at", "text"), "at")
    return stored(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(_block_links, "a long, b long"), "links")


def row_classes(rows: DataFrame) -> DataFrame:
    """``at``, ``n_shingles`` and ``class`` (null without shingles) of rows (``at``, a number of each one's own, ``text``)."""
    found = stored(signed(rows), "signatures")
    same = found.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("at").alias("member"))
    member_of = stored(found.filter("n > 0").select("at", "k1", "k2", "n").join(same, ["k1", "k2", "n"]).select("at", "member"), "member-of")
    members = found.join(member_of.filter("at = member").select("at"), "at", "left_semi")
    entries = members.select(F.explode("keys").alias("key"), "at", "n")
    heads = entries.groupBy("key").agg(F.min(F.struct("at", "n")).alias("head"), F.count("*").alias("c")).filter("c > 1").drop("c")
    entries = stored(entries.join(heads, "key"), "entries")
    first = head_links(entries, members, rows)
    label = stored(star_components(first), "classes")
    held = entries.join(label.withColumnRenamed("member", "at"), "at", "left").select("key", "at", "n", F.coalesce("class", "at").alias("class"))
    more = block_links(stored(held, "entries"), members, rows)
    if more.limit(1).count():
        label = star_components(first.union(more))
    of_row = member_of.join(label, "member", "left").select("at", F.coalesce("class", "member").alias("class"))
    return stored(found.select("at", F.col("n").alias("n_shingles")).join(of_row, "at", "left"), "of-row")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``kept``."""
    rows = placed(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "at")
    found = rows.select("at", "key").join(row_classes(rows.select("at", "text")), "at")
    smallest = found.filter("class is not null").groupBy("class").agg(F.min("key").alias("_least"))
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("_least"))
    out = found.join(smallest, "class", "left").select("key", "n_shingles", component.alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
