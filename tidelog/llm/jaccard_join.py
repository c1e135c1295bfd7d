"""N-gram Jaccard join by grouped prefixes: documents link when their shingle sets are similar enough.

Shingles are the distinct runs of five words (64-bit hashes). A global order puts frequent shingles last: all are
counted, by hash, in a partitioned table, and what goes to every task is the order of magnitude of a count, in bitmaps
of fixed size. A set's prefix is the shortest start of it, in that order, that two linked sets must share a shingle
in. A shingle that one document alone has can be in no overlap, so a set whose prefix holds only such ones is done;
the others are written once, without them.

Equal sets collapse to one member, members with the same size and the same shared part of the prefix to one group. The
list of a shingle holds the groups whose prefix has it. Two members of a list can link only where the shingle comes
early enough in both for what follows to reach the overlap that their sizes ask for; an entry that fails this against
the smallest size in its list leaves the list, before any join.

Links are wanted for the classes they form, so no class is compared with itself more than needed: in a first round
each group meets the head of every list of its (the group with the fewest rarer shingles), and each member the first
of its group; the links found form classes. In a second, complete round the groups of different classes that a list
still holds meet, under the size and position bounds; pairs whose common and remaining shingles can't reach the overlap
fall out, the rest are expanded to their members and verified. No link between classes is lost, and copies,
near copies and hot shingles cost a row per entry, not one per pair.

Defined results: A-Z lower-cased words; with one to four words the whole sequence is the one shingle; without words
or text a document is empty and linked with nothing (n_shingles 0, its own id). Rows with equal or null ids are
documents of their own, an id that is null never is a class's smallest unless all are. Equal sets are told by a
128-bit digest. Columns other than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.llm import words
from tidelog.llm.common import WHILE_WRITING, fresh, placed, settings, stored

SHINGLE, PERCENT = 5, 75
#: Counts from which a shingle is of the next level of the order. Level 0 is what one document alone has.
LEVELS = (2, *(4**k for k in range(1, 12)))
#: Bits of the bitmaps of the first level and of the others. In bitmaps that fill up shingles take a higher level than
#: theirs, which shifts work but no result.
BITS, HIGH_BITS = 27, 24
#: Shingles that a task sorts at once, and those that one cell of the count table shall hold, about.
HELD, CELL = 1_500_000, 1 << 20
#: Rows of a table of numbers that may be sent to the tasks that read the sets; beyond this the sets are shuffled to meet it.
SENT = 1_000_000
_SALTS = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], np.uint64)


class Order:
    """The level of every shingle, from one bitmap per level over the top bits of the hash."""

    def __init__(self) -> None:
        self.bits = [np.zeros((1 << (HIGH_BITS if k else BITS)) // 8, np.uint8) for k in range(len(LEVELS))]

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        left = np.arange(len(h))
        for k, bits in enumerate(self.bits):
            at = (h[left] >> np.uint64(64 - (HIGH_BITS if k else BITS))).astype(np.int64)
            left = left[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
            out[left] = k + 1
        return out


def shingle_order(docs: DataFrame, text: str = "text") -> Order:
    """Count all shingles of all documents and keep their levels.

    A cell of the count table holds the hashes that start with the same bits, as many cells as the input needs;
    within a cell 32 further bits tell hashes apart. Tasks add up what they read before it is shuffled, so a very
    frequent shingle is an entry per HELD shingles.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    top = int(np.clip(np.ceil(np.log2(max(size, 1) / 6 / CELL)), 8, 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in words.slices(batch, "text", words.SMALL_SLICE):
                held += words.shingle_sets(data, offsets, SHINGLE)
                n += sum(len(s) for s in held[-(len(offsets) - 1) :])
                if n >= HELD:
                    yield cells(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield cells(np.concatenate(held))

    def cells(h: np.ndarray) -> pa.RecordBatch:
        h = np.sort(h >> np.uint64(32 - top))
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(first, len(h))).astype(np.uint32)
        h = h[first]
        cell, begin = np.unique(h >> np.uint64(32), return_index=True)
        ends = np.append(begin[1:], len(h))
        low = h.astype(np.uint32)
        parts = {"once": [], "more": [], "times": []}
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            several = times[a:b] > 1
            for name, x in (("once", low[a:b][~several]), ("more", low[a:b][several]), ("times", times[a:b][several])):
                parts[name].append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts.values())], ["cell", *parts])

    def add(part: pa.Table) -> pa.Table:
        once, more, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32) for c in ("once", "more", "times"))
        h, c = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), times.astype(np.int64)])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c = h[first], np.add.reduceat(c, first)
        low = np.zeros(1 << (BITS - top), bool)
        low[h[c >= LEVELS[0]] >> np.uint32(5 + top)] = True
        high = [np.unique(h[c >= n] >> np.uint32(8 + top)).tobytes() for n in LEVELS[1:]]
        return pa.table([part.column("cell").slice(0, 1), pa.array([np.packbits(low).tobytes()], pa.binary()), pa.array([high], pa.list_(pa.binary()))], names=["cell", "low", "high"])

    table = docs.select(F.col(text).alias("text")).mapInArrow(count, "cell int, once binary, more binary, times binary").groupBy("cell").applyInArrow(add, "cell int, low binary, high array<binary>")
    out = Order()
    low = out.bits[0].reshape(1 << top, -1)
    high = [np.zeros(1 << HIGH_BITS, bool) for _ in LEVELS[1:]]
    with settings(docs.sparkSession, WHILE_WRITING):
        found = table.toArrow()  # bits of the bitmaps: of fixed size in all
    for batch in found.to_batches():
        for cell, own, more in zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high")), strict=True):
            low[cell] = np.frombuffer(own, np.uint8)
            for bits, x in zip(high, more, strict=True):
                bits[(cell << (HIGH_BITS - top)) + np.frombuffer(x, np.uint32).astype(np.int64)] = True
    out.bits[1:] = [np.packbits(x) for x in high]
    return out


def prefix_length(n):
    """Sets of n that link share one of the first this many: n less the least overlap, plus one."""
    return n * (100 - PERCENT) // 100 + 1


def shared_sets(docs: DataFrame, order: Order) -> DataFrame:
    """``carry``, ``n_shingles``, the set's digest ``k1``, ``k2`` and its shingles ``s`` that other documents may
    have, in the global order, of ``carry``, ``text``; ``s`` is empty where its prefix has none of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text", words.SMALL_SLICE):
                sets = words.shingle_sets(data, offsets, SHINGLE)
                sizes = np.array([len(s) for s in sets], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                h = np.concatenate(sets)
                full = np.flatnonzero(sizes)
                keys = np.zeros((2, len(sets)), np.uint64)
                for k, salt in zip(keys, _SALTS, strict=True):
                    if len(full):
                        k[full] = np.bitwise_xor.reduceat(words.mixed(h + salt), ends[full])
                level = order.levels(h)
                several = np.concatenate([[0], np.cumsum(level > 0)])
                common = several[ends[1:]] - several[ends[:-1]]
                owner = np.repeat(np.arange(len(sets)), sizes)
                some = np.flatnonzero((level > 0) & (sizes - common < prefix_length(sizes))[owner])
                some = some[np.lexsort((h[some], level[some], owner[some]))]
                bounds = np.searchsorted(owner[some], np.arange(len(sets) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("carry"), pa.array(sizes), *(pa.array(k.view(np.int64)) for k in keys),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[some].view(np.int64)))], ["carry", "n_shingles", "k1", "k2", "s"])

    kind = docs.schema["carry"].dataType.simpleString()
    return docs.select("carry", "text").mapInArrow(rows, f"carry {kind}, n_shingles long, k1 long, k2 long, s array<long>")


def overlap(a: Column, b: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(PERCENT * (a + b) / (100 + PERCENT))


def can_link(n: Column, at: Column, m: Column, mt: Column) -> Column:
    """Whether sets of n and m may link on a common shingle, their first, at places at and mt."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (at <= n - overlap(n, m)) & (mt <= m - overlap(n, m))


def in_reach(n: Column, at: Column, least: Column) -> Column:
    """Whether a set may link on a shingle at this place with any other of its list, whose least size is given."""
    return at <= n - overlap(n, F.greatest(least, F.ceil(PERCENT * n / 100)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` of members that link, by their sets (``row``, ``n``, ``s``).

    Only sets of members that are in a pair are shuffled, once per pair.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for s, t, n in zip(batch.column("s"), batch.column("t"), batch.column("n").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.asarray(s.values), np.asarray(t.values)]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= PERCENT * (n - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    pairs = stored(pairs, "pairs")
    few = pairs.count() <= SENT
    sent = lambda df: F.broadcast(df) if few else df
    a = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), "s")
    b = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("s").alias("t")).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    met = a.join(sent(pairs), "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "s", "t")
    return met.mapInArrow(check, "a long, b long, linked boolean").filter("linked").select("a", "b")


def classes(edges: DataFrame) -> DataFrame:
    """``member``, ``class``: the smallest member that each can reach over ``edges`` (a, b); by pointer jumping.

    Each round takes the smallest class among a member's neighbours, then the class of that class; the edges
    shrink to those between different classes. All tables stay in files.
    """
    label = stored(edges.select(F.col("a").alias("member")).union(edges.select("b")).distinct().withColumn("class", F.col("member")), "classes")
    left = edges
    while left.limit(1).count():
        # edges between classes: each class takes the smallest class it touches
        down = left.select(F.greatest("a", "b").alias("class"), F.least("a", "b").alias("to")).groupBy("class").agg(F.min("to").alias("to"))
        jumps = stored(down, "jumps")
        while True:  # follow chains to their ends
            far = jumps.alias("x").join(jumps.select(F.col("class").alias("to"), F.col("to").alias("next")), "to", "left")
            nearer = stored(far.select("class", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps")
            jumps = nearer.select("class", "to")
            if not nearer.filter("moved").limit(1).count():
                break
        label = stored(label.join(jumps, "class", "left").select("member", F.coalesce("to", "class").alias("class")), "classes")
        new = lambda c: F.coalesce(f"{c}_to", c)
        left = left.join(jumps.select(F.col("class").alias("a"), F.col("to").alias("a_to")), "a", "left").join(jumps.select(F.col("class").alias("b"), F.col("to").alias("b_to")), "b", "left")
        left = stored(left.select(new("a").alias("a"), new("b").alias("b")).filter("a <> b").distinct(), "edges")
    return label


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    found = row_classes(docs.select(F.struct(F.col(key).alias("key")).alias("carry"), F.col(text).alias("text")))
    found = found.select(F.col("carry.key").alias("_key"), "n_shingles", "class")
    smallest = found.filter("class is not null").groupBy("class").agg(F.min("_key").alias("component_id"))
    out = found.join(smallest, "class", "left")
    return out.select(F.col("_key").alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("_key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those linked, directly or not, to one of smaller id (ties: one of them stays)."""
    at = fresh(docs, "_at")
    rows = placed(docs, at)
    found = row_classes(rows.select(F.struct(F.col(key).alias("key"), F.col(at).alias("at")).alias("carry"), F.col(text).alias("text")))
    found = found.filter("class is not null").select("carry.*", "class")
    stays = found.groupBy("class").agg(F.min_by("at", F.struct(F.col("key").isNull(), "key", "at")).alias("stays"))
    goes = stored(found.join(stays, "class").filter("at <> stays").select(F.col("at").alias(at)), "goes")
    return rows.join(goes, at, "left_anti").drop(at)


def row_classes(docs: DataFrame) -> DataFrame:
    """``carry``, ``n_shingles`` and ``class`` (a number; null without shingles) of each row of ``carry``, ``text``.

    Rows are numbered as they are written with their sets; nothing relies on the order that the input is read in.
    """
    found = stored(shared_sets(docs, shingle_order(docs)).withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    # equal sets: one member each, the first row
    full = found.filter("n_shingles > 0").select("row", "k1", "k2", "n_shingles")
    same = full.groupBy("k1", "k2", "n_shingles").agg(F.min("row").alias("member"))
    member_of = stored(full.join(same, ["k1", "k2", "n_shingles"]).select("row", "member"), "member-of")
    n, unique = F.col("n_shingles"), F.col("n_shingles") - F.size("s")
    prefix = F.slice("s", F.lit(1), (F.floor(n * (100 - PERCENT) / 100) + 1 - unique).cast("int"))
    sets = found.filter(F.size("s") > 0).select("row", n.alias("n"), "s", prefix.alias("prefix"), F.xxhash64(prefix, n).alias("g"))
    # groups by size and shared prefix, named by their first member; equal sets are of the same group, so sets stay as they are written
    grouped = stored(sets.select("row", "n", "g").join(member_of.filter("row = member").select("row"), "row", "left_semi"), "members")
    first_of = grouped.groupBy("g").agg(F.min("row").alias("grp"))
    members = stored(grouped.join(first_of, "g").select("row", "n", "grp"), "grouped")
    heads = members.filter("row = grp").select("row")
    firsts = sets.select("row", "n", F.size("s").alias("size"), "prefix").join(F.broadcast(heads) if heads.count() <= SENT else heads, "row", "left_semi")
    entries = firsts.select(F.col("row").alias("grp"), "n", (F.col("n") - F.col("size")).alias("u"), F.posexplode("prefix").alias("k", "t"))
    entries = entries.select("t", "grp", "n", (F.col("u") + F.col("k")).alias("at"))
    lists = entries.groupBy("t").agg(F.min("n").alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c")
    entries = stored(entries.join(lists, "t").filter(in_reach(F.col("n"), F.col("at"), F.col("least"))).drop("least"), "entries")
    # first round: groups against the heads of their lists, members against the first of their group
    heads = entries.groupBy("t").agg(F.min(F.struct("at", "grp", "n")).alias("h"))
    near = entries.join(heads, "t").filter((F.col("grp") != F.col("h.grp")) & can_link(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at")))
    pairs = near.select(F.col("grp").alias("a"), F.col("h.grp").alias("b")).distinct()
    pairs = pairs.union(members.filter("row <> grp").select(F.col("row").alias("a"), F.col("grp").alias("b")))
    links = stored(verified(pairs, sets.select("row", "n", "s")), "links")
    label = classes(links)
    # second round: what is left, groups of different classes on a common shingle
    of_class = stored(members.join(label.withColumnRenamed("member", "row"), "row", "left").withColumn("class", F.coalesce("class", "row")), "of-class")
    span = of_class.groupBy("grp").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    left = several_classes(entries.join(span, "grp"))
    left = stored(several_classes(left.filter(in_reach(F.col("n"), F.col("at"), F.col("least"))).drop("least")).drop("least"), "entries")
    x, y = (left.select("t", *[F.col(c).alias(f"{side}_{c}") for c in ("grp", "n", "at", "lo", "hi")]) for side in "ab")
    same_class = (F.col("a_lo") == F.col("b_hi")) & (F.col("a_hi") == F.col("b_lo"))
    both = x.join(y, (x["t"] == y["t"]) & (F.col("a_grp") < F.col("b_grp")) & ~same_class & can_link(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at")))
    met = both.groupBy("a_grp", "b_grp", "a_n", "b_n").agg(F.count("*").alias("common"), F.max("a_at").alias("pa"), F.max("b_at").alias("pb"))
    # what follows the last common prefix shingle bounds the rest of the overlap
    most = F.col("common") + F.least(F.col("a_n") - F.col("pa"), F.col("b_n") - F.col("pb")) - 1
    met = met.filter(most >= overlap(F.col("a_n"), F.col("b_n"))).select("a_grp", "b_grp")
    # members last: those of two such groups, or of one group, that are of different classes
    a, b = (of_class.select(F.col("row").alias(s), F.col("grp").alias(f"{s}_grp"), F.col("class").alias(f"{s}_class")) for s in "ab")
    across = met.join(a, "a_grp").join(b, "b_grp").filter("a_class <> b_class").select("a", "b")
    split = of_class.join(span.filter("lo <> hi").select("grp"), "grp", "left_semi")
    a, b = (split.select(F.col("row").alias(s), "grp", F.col("class").alias(f"{s}_class")) for s in "ab")
    within = a.join(b, "grp").filter("a < b and a_class <> b_class").select("a", "b")
    more = stored(verified(across.union(within), sets.select("row", "n", "s")), "links")
    label = classes(links.union(more)) if more.limit(1).count() else label
    # back to all rows of equal sets
    of_row = member_of.join(label, "member", "left").select("row", F.coalesce("class", "member").alias("class"))
    return stored(found.select("carry", "n_shingles", "row").join(of_row, "row", "left").drop("row"), "of-row")


def several_classes(entries: DataFrame) -> DataFrame:
    """The ``entries`` of lists with groups of more than one class, and the ``least`` size in the list."""
    lists = entries.groupBy("t").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("n").alias("least")).filter("_lo <> _hi")
    return entries.join(lists.select("t", "least"), "t")
