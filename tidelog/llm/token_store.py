"""Token-ID output: a content-addressed store of token-id chunks with recipes and Merkle manifests.

Files under the store's path, all Parquet:

* ``chunks/pack=K`` - every distinct chunk once: ``digest`` (blake2b-128 of the id bytes), ``ids`` (uint16 or
  uint32 little-endian), ``n`` ids. A chunk's pack is a range of digests, so packs follow each other.
* ``recipes`` - a row per document in output order, within the files and from file to file by their numbers: ``start``, ``n_tokens``, its chunk digests in order, how many
  ids follow each chunk, Merkle ``root``.
* ``manifest`` - a row per pack: ``root`` of the Merkle tree over its digests in order, ``n_chunks``, ``n_ids``.

A rolling hash over the last ids cuts the id stream of a document into chunks, so copies share all chunks and
edited copies most of them. Reading verifies each chunk against its digest, each pack against its manifest and
each document against its recipe's root, and raises on a mismatch.

Defined results: null and empty texts hold the end id alone; documents with equal or null ids keep separate
rows (null ids first, equal ids in an arbitrary but fixed order); an empty table makes an empty store. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window

from tidelog.llm import words
from tidelog.llm.common import stored, write

END_ID = 2
#: Cut where the rolling hash of the last WINDOW ids has MASK's bits clear: one chunk end in 256 ids.
WINDOW, MASK, MAX_CHUNK = 16, np.uint64(0xFF00000000), 4096
#: Pieces beyond which a worker starts its pool anew before the next slice, the longest such piece, and how many the
#: tokenizer gets at once.
CACHED_PIECES, CACHED_LENGTH, LEARNED = 1_500_000, 256, 50_000
#: Chunks that are told apart in one task, about, how many such parts make a pack, and digests a task remembers.
PART_CHUNKS, PACK_PARTS, SEEN = 20_000, 64, 1_000_000
_OTHER_VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_GEAR = np.random.default_rng(5).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
_workers: dict[str, PieceEncoder] = {}


class Pool:
    """Id sequences by the 128-bit hash of a piece: ``keys`` are sorted, ``start`` has the bounds of a number's ids."""

    def __init__(self) -> None:
        self.keys, self.checks, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start, self.used, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of new pieces (``hashes`` has two rows), whose ids end at ``ends``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.size + len(ends) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.size + 1 : self.size + 1 + len(ends)] = self.used + ends
        numbers = np.arange(self.size, self.size + len(ends), dtype=np.int32)
        self.used, self.size = self.used + len(ids), self.size + len(ends)
        order = np.argsort(hashes[0])
        at = np.searchsorted(self.keys, hashes[0][order])
        self.keys, self.checks, self.number = (np.insert(old, at, new[order]) for old, new in ((self.keys, hashes[0]), (self.checks, hashes[1]), (self.number, numbers)))
        return numbers

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(hashes.shape[1], -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes[0]), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes[0]) & (self.checks[at] == hashes[1]), self.number[at].astype(np.int64), -1)

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these numbers in turn, the end of each)."""
        size = self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[numbers] - ends + size, size) + np.arange(total)], ends


def piece_hashes(found: pa.LargeBinaryArray) -> np.ndarray:
    """Two hashes of each of some non-empty pieces."""
    bounds = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    if not len(found):
        return np.zeros((2, 0), np.uint64)
    data = np.frombuffer(found.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    length = np.diff(bounds)
    within = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], length)
    power = words.powers(words._RADIX, int(length.max()))[within]
    starts = bounds[:-1] - bounds[0]
    return np.stack([words.mixed(np.add.reduceat(value[data] * power, starts) + length.astype(np.uint64) * words._STEP) for value in (words._BYTE_VALUE, _OTHER_VALUE)])


class PieceEncoder:
    """Ids of whole texts, piece by piece: the tokenizer splits at white space and where letters, digits and
    punctuation meet, so such pieces are encoded once and their ids kept.

    A text is encoded as it is, by the tokenizer alone, where that could differ: with a special token's start,
    a control character, a non-ASCII character that is no letter, or a very long piece. Words with an apostrophe stay
    whole, for the tokenizer may read it with letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pool = Pool()

    def encode_apart(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of pieces encoded together, parted by blanks; the places of the ids tell them apart."""
        begins = np.cumsum([0, *(len(x) + 1 for x in names)])
        done = self.tokenizer.encode(" ".join(names), add_special_tokens=False)
        at = np.array(done.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        return np.array(done.ids, dtype=np.uint32), np.searchsorted(at, begins[1:], "left")

    def learn(self, new: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Take pieces into the pool and give their numbers.

        Most end with their only word-end token; where that doesn't hold, places decide.
        """
        names = b" ".join([x.strip() for x in new]).decode().split(" ")
        alpha = np.fromiter(map(str.isalpha, names), bool, len(names))
        blank = np.fromiter(map(len, names), np.int64, len(names)) == 0
        numbers = np.zeros(len(new), np.int64)
        simple, other, blank = (np.flatnonzero(x) for x in (alpha, ~alpha & ~blank, blank))
        if len(simple):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([names[i] for i in simple])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(simple) or ends[-1] != len(ids):
                ids, ends = self.encode_apart([names[i] for i in simple])
            numbers[simple] = self.pool.add(hashes[:, simple], ids, ends)
        if len(other):
            numbers[other] = self.pool.add(hashes[:, other], *self.encode_apart([names[i] for i in other]))
        if len(blank):
            numbers[blank] = self.pool.add(hashes[:, blank], np.zeros(0, np.uint32), np.zeros(len(blank), np.int64))
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, with END_ID after each text; the end of each text in them) of texts in one buffer."""
        n = len(offsets) - 1
        if self.pool.size > CACHED_PIECES:  # between slices only: what a slice needs stays until it is encoded
            self.pool = Pool()
        codes, owner, found, odd = pieces(data, offsets)
        hashes = piece_hashes(found)
        numbers = self.pool.numbers(hashes)
        new = np.flatnonzero(numbers < 0)  # what is known was found fit before
        names = found.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
        fit = np.array([len(x) <= CACHED_LENGTH and (x.isascii() or kept_letters(x)) for x in names], bool)
        if not fit.all():
            odd[np.unique(owner[np.isin(codes, new[~fit])])] = True
        new, names = new[fit], [x for x, ok in zip(names, fit.tolist(), strict=True) if ok]
        for k in range(0, len(names), LEARNED):
            numbers[new[k : k + LEARNED]] = self.learn(names[k : k + LEARNED], hashes[:, new[k : k + LEARNED]])
        if odd.any():
            keep = ~odd[owner]
            codes, owner = codes[keep], owner[keep]
        ids, ends = self.pool.gathered(numbers[codes])
        of_text = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(n), "right")]
        if not odd.any():
            return np.insert(ids, of_text, END_ID), of_text + np.arange(1, n + 1)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in np.flatnonzero(odd)]
        own = iter(self.tokenizer.encode_batch(texts, add_special_tokens=False))
        parts = [np.append(np.array(next(own).ids, np.uint32) if odd[i] else ids[(of_text[i - 1] if i else 0) : of_text[i]], np.uint32(END_ID)) for i in range(n)]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


def kept_letters(name: bytes) -> bool:
    """Whether a piece with non-ASCII characters is letters only, in lower case too."""
    text = name.strip().decode("utf-8", "replace")
    return text.isalpha() and text.lower().isalpha()


#: Byte classes: 0 white space, 1 letters (with all non-ASCII bytes), 2 digits, 3 punctuation, 4 other controls.
_CLASS = np.array([0 if i in (32, *range(9, 14)) else 4 if i < 32 or i == 127 else 2 if 48 <= i <= 57 else 1 if i >= 128 or chr(i).isalpha() else 3 for i in range(256)], np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """The runs of one byte class of the texts, A-Z lower-cased, each with the white space before it: (number among the
    distinct ones, its text), the distinct ones, and which texts must be encoded as they are."""
    n = len(offsets) - 1
    odd = np.zeros(n, bool)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary()), odd
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
    quotes = np.flatnonzero(data == 39)
    if len(quotes):  # words with an apostrophe stay whole
        blanks = np.flatnonzero(kind == 0)
        first = np.append(0, blanks + 1)[np.searchsorted(blanks, quotes)]
        last = np.append(blanks, len(data))[np.searchsorted(blanks, quotes)]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[np.unique(first) + 1] = 1
        inside[np.unique(last)] -= 1
        change &= np.cumsum(inside[:-1], dtype=np.int8) == 0
    edges = offsets[1:-1]
    change[edges[edges < len(data)]] = True
    start = np.flatnonzero(change)
    strange = np.flatnonzero((kind == 4) | ((data == 60) & (np.append(data[1:], 0) == 124)))
    if len(strange):
        odd[np.unique(np.searchsorted(offsets, strange, "right") - 1)] = True
    tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(words._LOWER[data])])
    told = tiles.dictionary_encode()
    return np.asarray(told.indices), np.searchsorted(offsets, start, "right") - 1, told.dictionary, odd


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sorted chunk ends of texts that end at ``ends``."""
    h, k = _GEAR[ids & 0xFFFF], 1
    while k < WINDOW:  # of the last k ids, then of the last 2 k
        h[k:] += h[:-k] << np.uint64(2 * k)
        k *= 2
    found = np.flatnonzero((h & MASK) == 0) + 1
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.searchsorted(ends, found, "left")
    found = found[found - starts[owner] >= WINDOW]  # else the hash would see ids of the text before
    all_cuts = np.union1d(found, ends)
    gaps = np.diff(all_cuts, prepend=0)
    wide = np.flatnonzero(gaps > MAX_CHUNK)
    more = [np.arange(all_cuts[i] - gaps[i] + MAX_CHUNK, all_cuts[i], MAX_CHUNK) for i in wide]
    return np.union1d(all_cuts, np.concatenate(more)) if more else all_cuts


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    level = digests or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return digest(level[0])


CHUNK_SCHEMA = "carry {}, n_tokens long, digests array<binary>, sizes array<int>, new array<binary>"


def encoded_chunks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row per document: its chunk digests and sizes, and the bytes of chunks that its task saw first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _workers:
            _workers[tokenizer_path] = PieceEncoder(tokenizer_path)
        encoder, seen = _workers[tokenizer_path], set()
        for batch in batches:
            for part, data, offsets in words.slices(batch, "text", words.SLICE_BYTES // 2):
                yield block(*encoder.encode(data, offsets), seen, part)

    def block(ids: np.ndarray, ends: np.ndarray, seen: set, part: pa.RecordBatch) -> pa.RecordBatch:
        wide = int(ids.max()) > 0xFFFF
        raw = ids.astype("<u4" if wide else "<u2").tobytes()
        width = 4 if wide else 2
        stops = cuts(ids, ends)
        starts = np.concatenate([[0], stops[:-1]])
        of_doc = np.concatenate([[0], np.searchsorted(stops, ends, "right")])
        names, new = [], []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            piece = raw[a * width : b * width]
            name = digest(bytes([width]) + piece)
            names.append(name)
            new.append(None if name in seen else piece)
            seen.add(name)
        if len(seen) > SEEN:  # what is sent again is dropped where all chunks meet
            seen.clear()
        lists = [pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), x) for x in (pa.array(names, pa.binary()), pa.array((stops - starts).astype(np.int32)), pa.array(new, pa.binary()))]
        sizes = np.diff(ends, prepend=0)
        return pa.RecordBatch.from_arrays([part.column("carry"), pa.array(sizes), *lists], ["carry", "n_tokens", "digests", "sizes", "new"])

    return docs.select("carry", "text").mapInArrow(rows, CHUNK_SCHEMA.format(docs.schema["carry"].dataType.simpleString()))


def _part(name: Column, parts: int) -> Column:
    """The part of a digest: ranges of its first 32 bits."""
    return F.shiftright(F.conv(F.substring(F.hex(name), 1, 8), 16, 10).cast("long") * parts, 32).cast("int")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, order: tuple[str, ...] = ("doc_id",)) -> None:
    """Encode ``docs`` (doc_id, text) and write chunks, recipes and manifest under ``path``.

    The output order is that of the ``order`` columns, ascending; rows alike in them are told apart by a number that
    is written with their ids. Tokens pass a shuffle once, for the chunks.
    """
    by = [f"o{i}" for i in range(len(order))]
    carry = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(o) for c, o in zip(order, by, strict=True)])
    staged = encoded_chunks(docs.select(carry.alias("carry"), "text"), tokenizer_path)
    staged = stored(staged.withColumn("row", F.monotonically_increasing_id()), "token-chunks")
    pieces = staged.select(F.explode(F.arrays_zip("digests", "sizes", "new")).alias("c")).filter("c.new is not null").select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.new").alias("ids"))
    parts = max(1, round((staged.agg(F.sum(F.size(F.array_compact("new")))).first()[0] or 0) / PART_CHUNKS))
    unique = pieces.withColumn("part", _part(F.col("digest"), parts)).repartition(parts, "part").dropDuplicates(["part", "digest"])
    write(unique.withColumn("pack", F.floor(F.col("part") / PACK_PARTS).cast("int")).drop("part"), f"{path}/chunks", by="pack")
    write(pack_roots(docs.sparkSession, path), f"{path}/manifest")
    ranged = staged.select("carry", "row", "n_tokens", "digests", "sizes").orderBy(*[f"carry.{o}" for o in by], "row")
    ranged = stored(ranged.select(F.col("carry.doc_id").alias("doc_id"), "n_tokens", "digests", "sizes").mapInArrow(_summed, f"part int, {RECIPE_SCHEMA}"), "token-ranges")
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    recipes = ranged.join(before, "part").withColumn("start", F.col("start") + F.col("before"))
    # what was read back is in no order of its files; starts put it in that of the output
    write(recipes.drop("part", "before").orderBy("start"), f"{path}/recipes")


RECIPE_SCHEMA = "doc_id long, start long, n_tokens long, digests array<binary>, after array<long>, root binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of the sorted rows of a partition: ``start`` counts within it; ``after`` are a document's ids past each chunk."""
    at = 0
    for batch in batches:
        n, sizes = np.asarray(batch.column("n_tokens")), batch.column("sizes")
        ends = np.cumsum(n)
        bounds = np.asarray(sizes.offsets) - np.asarray(sizes.offsets)[0]
        into = np.cumsum(np.asarray(sizes.flatten()), dtype=np.int64)  # every document has a chunk and the chunks hold all its ids
        after = np.repeat(ends, np.diff(bounds)) - into
        roots = [merkle_root(x) for x in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(n), TaskContext.get().partitionId(), np.int32)), batch.column("doc_id"), pa.array(at + ends - n), batch.column("n_tokens"),
            batch.column("digests"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(after)), pa.array(roots, pa.binary())],
            ["part", "doc_id", "start", "n_tokens", "digests", "after", "root"])
        at += int(ends[-1]) if len(ends) else 0


def pack_roots(spark: SparkSession, path: str) -> DataFrame:
    """Merkle root, chunks and ids of each pack, from the chunk files; a pack is bounded by its digests."""

    def root(part: pa.Table) -> pa.Table:
        own = {"root": pa.array([merkle_root(sorted(part.column("digest").to_pylist()))], pa.binary()), "n_chunks": pa.array([part.num_rows]), "n_ids": pa.array([int(np.asarray(part.column("n")).sum())])}
        return pa.table({"pack": part.column("pack").slice(0, 1), **own})

    chunks = spark.read.schema("digest binary, n int, ids binary, pack int").parquet(f"{path}/chunks")
    return chunks.select("pack", "digest", "n").groupBy("pack").applyInArrow(root, "pack int, root binary, n_chunks long, n_ids long")


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``digest``, ``n`` and ``crc`` (of the ids as little-endian uint32) of each stored chunk, bytes checked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raws, sizes = (batch.column(c).to_pylist() for c in ("digest", "ids", "n"))
            crcs = []
            for name, raw, n in zip(names, raws, sizes, strict=True):
                width = len(raw) // n
                if digest(bytes([width]) + raw) != name or width * n != len(raw):
                    raise ValueError(f"chunk {name.hex()} doesn't match its digest")
                crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return spark.read.schema("digest binary, n int, ids binary, pack int").parquet(f"{path}/chunks").select("digest", "n", "ids").mapInArrow(rows, "digest binary, n int, crc long")


def _gf2_times(matrix: list[int], vector: int) -> int:
    total = 0
    for k in range(32):
        if vector >> k & 1:
            total ^= matrix[k]
    return total


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 values as they count in a text that goes on for n further bytes; such values add up by xor."""
    matrix = [0xEDB88320, *(1 << k for k in range(31))]  # a shift by one bit
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64) << 3
    while n.any():
        odd = np.flatnonzero(n & 1)
        if len(odd):
            x, y = out[odd], np.zeros(len(odd), np.uint32)
            for k in range(32):
                y ^= np.where(x >> np.uint32(k) & np.uint32(1), np.uint32(matrix[k]), np.uint32(0))
            out[odd] = y
        n >>= 1
        matrix = [_gf2_times(matrix, column) for column in matrix]
    return out


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_shifted(np.asarray(batch.column("crc").fill_null(0)), 4 * np.asarray(batch.column("after")))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens", "n", "missing")), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "n", "missing", "part"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if [merkle_root(x) for x in batch.column("digests").to_pylist()] != batch.column("root").to_pylist():
            raise ValueError("a document doesn't match its recipe")
        yield batch.select(["doc_id", "start", "n_tokens", "digests", "after"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Verify a store and return per document ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    Every chunk is read once; documents join crcs and sizes of their chunks, not the ids themselves.
    """
    manifest = spark.read.schema("pack int, root binary, n_chunks long, n_ids long").parquet(f"{path}/manifest")
    if pack_roots(spark, path).exceptAll(manifest).limit(1).count():
        raise ValueError("a pack doesn't match the manifest")
    recipes = spark.read.schema(RECIPE_SCHEMA).parquet(f"{path}/recipes").mapInArrow(_rooted, "doc_id long, start long, n_tokens long, digests array<binary>, after array<long>")
    uses = recipes.select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("digests", "after")).alias("c")).select("doc_id", "start", "n_tokens", F.col("c.digests").alias("digest"), F.col("c.after").alias("after"))
    found = uses.join(verified_chunks(spark, path), "digest", "left").select("doc_id", "start", "n_tokens", "after", "crc", "n", F.col("crc").isNull().alias("missing"))
    parts = found.mapInArrow(_shifted, "doc_id long, start long, n_tokens long, n int, missing boolean, part long")
    docs = parts.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), (F.max("missing") | (F.sum("n") != F.col("n_tokens"))).alias("wrong"))
    wrong = F.raise_error(F.lit("a document's chunks are missing or of another length")).cast("long")
    return docs.select("doc_id", "start", "n_tokens", F.when(F.col("wrong"), wrong).otherwise(F.col("ids_crc32")).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of each document themselves, rebuilt from the chunks: ``doc_id``, ``start``, ``ids``."""
    chunks = spark.read.schema("digest binary, n int, ids binary, pack int").parquet(f"{path}/chunks").select("digest", "ids", "n")
    uses = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("k", "digest"))
    parts = uses.join(chunks, "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "n"))).alias("parts"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "start"]].assign(ids=[np.concatenate([np.frombuffer(x["ids"], f"<u{len(x['ids']) // x['n']}").astype(np.int32) for x in own]) for own in pdf["parts"]])

    return parts.mapInPandas(rows, "doc_id long, start long, ids array<int>")
