"""Canonical length-limited Huffman codes over token ids, encoded and decoded with numpy.

A code is its lengths alone: among symbols with a code, shorter codes come first and equal
lengths go by symbol. Lengths come from global counts by package-merge, which is optimal
under the limit. Ids are coded in blocks of ``BLOCK``; the bit offset of every block is kept,
so any block can be decoded by itself and many blocks are decoded side by side, one table
lookup a step.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20            # with up to 7 bits of a byte before it a code lies within 32 bits
BLOCK = 256
SECTION = 256         # blocks coded at a time; a section starts at a whole byte
LANES = 4096          # blocks decoded side by side


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of every symbol's code (0: the symbol does not occur), at most ``limit``, with the least total.

    No symbols give all zeros; one symbol gets one bit. Ties go to the smaller symbol.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts > 0)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    leaves, merged = [], np.zeros(0, np.int64)
    for _ in range(limit):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        leaves.append(place < len(weights))
    # The chosen items of a level are a prefix of it, and its packages a prefix of the level before.
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for leaf in reversed(leaves):
        singles = int(leaf[:take].sum())
        bits[:singles] += 1
        take = 2 * (take - singles)
    lengths[order] = bits
    return lengths


class Code:
    """Both directions of the canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        bits = self.lengths[order].astype(np.int64)
        self.bits = int(bits.max(initial=1))
        span = np.int64(1) << (self.bits - bits)          # table entries a code covers
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(self.lengths), np.uint32)
        self.codes[order] = (first >> (self.bits - bits)).astype(np.uint32)
        covered = int(span.sum())
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.step = np.ones(1 << self.bits, np.uint8)
        self.symbol[:covered] = np.repeat(order, span)
        self.step[:covered] = np.repeat(bits, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(coded bytes, bit offset of each block). An id without a code is an error."""
        parts, offsets, base = [], [], 0
        for start in range(0, len(ids), BLOCK * SECTION):
            part = ids[start : start + BLOCK * SECTION]
            length = self.lengths[part].astype(np.int64)
            if not length.all():
                raise ValueError("an id has no code")
            ends = np.cumsum(length)
            at = ends - length
            size = (int(ends[-1]) + 7) // 8
            word = self.codes[part].astype(np.uint64) << (32 - length - (at & 7)).astype(np.uint64)
            byte = at >> 3
            sums = np.zeros(size + 4)
            for k in range(4):  # bits do not overlap, so adding is setting
                sums += np.bincount(byte + k, ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), size + 4)
            parts.append(sums[:size].astype(np.uint8).tobytes())
            offsets.append(at[::BLOCK] + 8 * base)
            base += size
        return b"".join(parts), np.concatenate(offsets) if offsets else np.zeros(0, np.int64)

    def decode(self, data: np.ndarray, offsets: np.ndarray, n: int, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
        """Ids of blocks ``first_block`` to ``last_block`` (not included) out of ``n`` coded ids."""
        last = len(offsets) if last_block is None else min(last_block, len(offsets))
        out = []
        for lane in range(first_block, last, LANES):
            starts = offsets[lane : min(lane + LANES, last)].astype(np.int64)
            base = int(starts[0]) >> 3
            # Every id of the last lane may take the longest code; what lies behind the data reads as zeros.
            part = np.zeros(int(starts[-1] >> 3) - base + BLOCK * self.bits // 8 + 8, np.uint32)
            have = data[base : base + len(part)]
            part[: len(have)] = have
            window = (part[:-3] << np.uint32(24)) | (part[1:-2] << np.uint32(16)) | (part[2:-1] << np.uint32(8)) | part[3:]
            at = starts - 8 * base
            ids = np.empty((BLOCK, len(starts)), np.uint32)
            for k in range(BLOCK):
                entry = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
                ids[k] = self.symbol[entry]
                at += self.step[entry]
            out.append(ids.T.ravel())
        found = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return found[: max(min(n, last * BLOCK) - first_block * BLOCK, 0)]
