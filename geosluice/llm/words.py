"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return (all ASCII, so multi-byte characters stay
whole).  Everything works on the raw UTF-8 bytes of a batch, in slices of a few
megabytes, so memory is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1 << 32, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[list(SEPARATORS)] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_BASE = 0x9E3779B97F4A7C15
_ROLL = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


@dataclass
class Words:
    """Words of a slice of texts: document i has words bounds[i]:bounds[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text makes a range of its own."""
    _, offsets = text_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text with a 64-bit hash; `lower` folds A-Z only."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    if len(start) == 0:
        return Words(data, start, end, np.zeros(0, np.uint64), bounds)
    longest = int((end - start).max())
    power = _POW if longest <= len(_POW) else _powers(longest)
    place = np.arange(n, dtype=np.int64)
    place[start[0] :] -= np.repeat(start, np.diff(start, append=n))
    np.clip(place, 0, longest - 1, out=place)
    value = (_BYTE_LOWER if lower else _BYTE)[data]
    value *= power[place]
    return Words(data, start, end, mix(np.add.reduceat(value, start)), bounds)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each position on; the last k - 1 positions are left out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, size, weight = h, 1, _ROLL
    total, have, have_weight = None, 0, 1
    left = k
    while True:
        if left & 1:
            if total is None:
                total, have, have_weight = out, size, weight
            else:
                m = min(len(total), len(out) - have)
                total = total[:m] + out[have : have + m] * np.uint64(have_weight)
                have, have_weight = have + size, have_weight * weight & _MASK
        left >>= 1
        if not left:
            return mix(total[: len(h) - k + 1])
        m = len(out) - size
        out = out[:m] + out[size:] * np.uint64(weight)
        size, weight = size * 2, weight * weight & _MASK


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each document, not yet distinct, and their bounds.

    A document with 1 to k - 1 words has its whole sequence as one shingle."""
    h = rolling(w.hash, k)
    count = np.diff(w.bounds)
    many = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k)
    bounds = np.zeros(len(count) + 1, np.int64)
    np.cumsum(many + short, out=bounds[1:])
    out = np.empty(int(bounds[-1]), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        at = np.repeat(bounds[full] - w.bounds[full], many[full])
        take = np.arange(len(at)) - np.repeat(np.cumsum(many[full]) - many[full], many[full]) + np.repeat(w.bounds[full], many[full])
        out[take + at] = h[take]
    for i in np.flatnonzero(short):
        own = w.hash[w.bounds[i] : w.bounds[i + 1]]
        out[bounds[i]] = rolling(own, len(own))[0] ^ np.uint64(len(own))
    return out, bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each document."""
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
