"""Vectorised words and word n-grams of Arrow text batches (runs inside Spark tasks).

Words are maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased; n-grams are 64-bit
hashes of n consecutive words of one text. Whole texts are read, in slices of a few MB of several texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: The same for passes that need nothing of a slice but its rows: some thirty to sixty bytes are held for each of these.
SMALL_SLICE = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_RADIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def unmixed(h: np.ndarray) -> np.ndarray:
    """What ``mixed`` was given."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return h ^ (h >> np.uint64(33))


def inner_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first n - 1, last n - 1 and middle n - 2 words, of n-gram hashes and their outer words.

    An n-gram's hash is a number in base _STEP with the words as digits and n before them, mixed; for n = 2 the
    last word follows from the first.
    """
    step = [np.uint64(pow(int(_STEP), k, 1 << 64)) for k in range(n + 1)]
    under = np.uint64(pow(int(_STEP), -1, 1 << 64))
    count = [np.uint64(m * int(step[m]) % (1 << 64)) for m in range(n + 1)]
    digits = unmixed(h) - count[n]
    if last is None:
        last = digits - first * step[1]
    head = (digits - last) * under
    tail = digits - first * step[n - 1]
    middle = head - first * step[n - 2]
    return tuple(mixed(x + count[m]) for x, m in ((head, n - 1), (tail, n - 1), (middle, n - 2)))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, byte offsets of the texts) in row order; null texts are empty."""
    texts = pc.fill_null(batch.column(column), "")
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Separators that leave letters and digits only (of ASCII).
PUNCTUATION = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~separators[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    start[edges] |= inside[edges]  # a text begins a word of its own
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = np.diff(starts, append=len(data))
    within = np.arange(len(data) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], spans)
    value = _BYTE_VALUE[_LOWER[data[starts[0] :]]] * powers(_RADIX, int(spans.max()))[within]
    value[~inside[starts[0] :]] = 0
    return mixed(np.add.reduceat(value, starts - starts[0])), np.searchsorted(offsets, starts, "right") - 1


class HashFilter:
    """A bitmap of fixed size over hashes: no hash that was added is missed, few others pass."""

    BITS = 27

    def __init__(self, hashes: np.ndarray | None = None):
        self.words = np.zeros(1 << (self.BITS - 6), np.uint64)
        if hashes is not None:
            self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        bit = hashes >> np.uint64(64 - self.BITS)
        np.bitwise_or.at(self.words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - self.BITS)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def ngram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of n words of one text, in order."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        h = h * _STEP + words[j : j + m]
    whole = owner[:m] == owner[n - 1 :]
    return mixed(h[whole]), owner[:m][whole]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; with 1 to n - 1 words, all of them as one."""
    words, owner = word_hashes(data, offsets)
    h, of = ngram_hashes(words, owner, n)
    count = len(offsets) - 1
    at, word_at = np.searchsorted(of, np.arange(count + 1)), np.searchsorted(owner, np.arange(count + 1))
    out = []
    for i in range(count):
        few = word_at[i + 1] - word_at[i]
        if 0 < few < n:
            out.append(ngram_hashes(words[word_at[i] : word_at[i + 1]], owner[word_at[i] : word_at[i + 1]], int(few))[0])
        else:
            out.append(np.unique(h[at[i] : at[i + 1]]))
    return out
