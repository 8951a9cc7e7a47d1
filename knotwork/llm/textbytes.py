"""Words and hashes of many texts at once, in numpy, straight from Arrow's UTF-8 buffers.

Byte classes suffice: a byte from 0x80 on is always part of a non-ASCII character, and only A-Z are lower-cased.
Work goes in slices of a few MB, so memory is bounded by a slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x09:0x0E] = NONSPACE[0x20] = False

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _tables[k] = np.cumprod(t)
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of slices of at most limit bytes, or of one text. Null: no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, kind, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word (one more than texts).

    data is already lower-cased; no word goes over the border of two texts.
    """
    inside = table[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first = before[:-1].copy()
    first[cut] = False
    starts = np.flatnonzero(inside & ~first)
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(word_hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, or of all its words if they are fewer, and where each text's runs begin."""
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(grams, out=begin[1:])
    total = int(begin[-1])
    if not total:
        return np.zeros(0, np.uint64), begin
    at = np.arange(total) + np.repeat(first[:-1] - begin[:-1], grams)
    limit = np.repeat(first[1:], grams)
    h = np.full(total, n, np.uint64)
    for k in range(n):
        here = at + k
        ok = here < limit
        step = word_hashes[np.where(ok, here, 0)] + np.uint64(0x632BE59BD9B4E019)
        h = np.where(ok, h * np.uint64(0x9FB21C651E98DF25) + step, h * np.uint64(3))
    return mix(h), begin


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start as often as its count says, end to end."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - begin, counts)
