"""Words and shingles of whole Arrow string columns, as numpy arrays.

A word is a run of bytes of one class, so it is found on the UTF-8 bytes of a slice of
documents at once, without a Python object per word. Words and shingles are named by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
NOT_SPACE = ~np.isin(_BYTES, [0x20, 9, 10, 11, 12, 13])
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_RANDOM = np.random.default_rng(20240517)
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
# Two more odd bases for the 128-bit name of a whole word sequence.
_SEQUENCE = [int(x) | 1 for x in _RANDOM.integers(1 << 40, 1 << 63, 2, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, document offsets into them) for slices of about SLICE_BYTES; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    offsets: np.ndarray  # of each document's words, one more than documents
    starts: np.ndarray   # bytes in the slice
    ends: np.ndarray
    hashes: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    """LOWER[data]. Bytes are compared many at a time, which is faster than a lookup each."""
    capital = (data - np.uint8(65)) < np.uint8(26)
    return data + (capital.view(np.uint8) << np.uint8(5))


def words(data: np.ndarray, documents: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    """Words of a slice, A-Z lowered; ``kind`` says which bytes (after lowering) belong to words."""
    lowered = _lowered(data)
    inside = (lowered != 0x20) & ((lowered - np.uint8(9)) >= np.uint8(5)) if kind is NOT_SPACE else kind[lowered]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = documents[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(starts, documents), starts, stops, _hashes(lowered, starts, stops))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base : ends[last - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        values = _BYTE_VALUE[part]
        values *= powers(_BASE, len(part))
        np.cumsum(values, out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * powers(_BASE_INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets per document, hashes): each run of ``size`` words in order; a shorter text is one shingle."""
    counts = np.diff(w.offsets)
    total = len(w.hashes)
    made = np.zeros(max(total - size + 1, 0), np.uint64)
    for j in range(size):
        made += w.hashes[j : j + len(made)] * _PLACE[j]
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_doc, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    long = counts >= size
    place = np.arange(len(out)) - np.repeat(offsets[:-1], per_doc) + np.repeat(w.offsets[:-1], per_doc)
    whole = np.repeat(long, per_doc)
    out[whole] = made[place[whole]]
    for n in range(1, size):
        docs = np.flatnonzero(counts == n)
        value = np.full(len(docs), n, np.uint64) * _PLACE[63]
        for j in range(n):
            value = value + w.hashes[w.offsets[docs] + j] * _PLACE[j]
        out[offsets[docs]] = value
    return offsets, mix(out)


def names(w: Words) -> list[bytes]:
    """A 128-bit name of each document's word sequence."""
    counts = np.diff(w.offsets)
    place = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], counts)
    halves = []
    for k, base in enumerate(_SEQUENCE):
        longest = int(counts.max(initial=0))
        terms = mix(w.hashes + np.uint64(k)) * powers(base, longest + 1)[place]
        sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        halves.append(mix(sums[w.offsets[1:]] - sums[w.offsets[:-1]] + counts.astype(np.uint64) * _PLACE[60 + k]))
    return [row.tobytes() for row in np.stack(halves, axis=1)]
