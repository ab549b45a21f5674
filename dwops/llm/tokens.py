"""Token ids of whole texts by a byte-level BPE tokenizer file.

Byte-level BPE merges only inside the pieces its pattern cuts a text into, and cutting a
piece again gives the same piece. So the ids of a piece are encoded once and kept, and a
text of ordinary characters is a join of kept pieces. A text with any other character is
encoded whole by the tokenizer. Both ways give the tokenizer's own ids.

Where the file's merges come in the order of their ids, as byte-level files of this kind have
them, a new piece is merged by rank, which is the same rule without the tokenizer's cost per call.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

PIECES_KEPT = 500_000
ID = np.dtype("<u4")

# Ordinary characters: those for which this pattern and the tokenizer's agree on letters, digits and blanks.
ORDINARY = r"\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ–—‘’“”…"
_UNUSUAL = re.compile(f"[^{ORDINARY}]")
_LETTER, _DIGIT = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9"
_PIECE = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
)
LONG_PIECE = 64


def default_path() -> str:
    """The tokenizer file that stands in the environment's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranked(tokenizer):
    """A function from a piece's bytes to ids by merge ranks, or None where the file does not allow it."""
    import sys

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    vocabulary = model.get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    order = [vocabulary.get(a + b, -1) for a, b in merges]
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    plain = model.get("type") == "BPE" and all(c in vocabulary for c in byte) and array("I").itemsize == 4 and sys.byteorder == "little"
    if not plain or order != sorted(set(order)) or not order or min(order) < 256 or max(vocabulary[c] for c in byte) > 255 or model.get("dropout"):
        return None
    ranks = {bytes([b]): vocabulary[c] for c, b in byte.items()} | {bytes(byte[c] for c in a + b): i for (a, b), i in zip(merges, order)}
    encoding = tiktoken.Encoding("from-file", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece


class Encoder:
    """Texts -> little-endian 32-bit ids as bytes."""

    def __init__(self, file: str | bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file) if isinstance(file, bytes) else Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # a separator's name in a text is ordinary text
        self.ranked = _ranked(self.tokenizer)
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def __call__(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.whole(text)
        pieces = _PIECE.findall(text)
        kept = self.kept
        new = [p for p in set(pieces) if p not in kept]
        if new:
            if len(kept) + len(new) > PIECES_KEPT:
                kept.clear()
                new = list(set(pieces))
            if self.ranked:
                for piece in new:
                    kept[piece] = array("I", self.ranked(piece.encode())).tobytes()
            else:
                for piece, ids in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    kept[piece] = np.array(ids.ids, ID).tobytes()
        return b"".join([kept[p] for p in pieces])


def share_tokenizer(spark, path: str | None = None):
    """The tokenizer file (a few megabytes) as a broadcast, so that executors need no copy of their own."""
    with open(path or default_path(), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(shared) -> Encoder:
    """The worker process's encoder for a shared tokenizer file, kept between tasks."""
    if not hasattr(shared, "encoder"):
        shared.encoder = Encoder(shared.value)
    return shared.encoder
