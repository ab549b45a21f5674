"""Token ids by a BPE tokenizer file with word ends, which lowers texts and drops white space.

The file's rule cuts the normalised text into pieces and merges inside a piece alone, and a
piece cut again is itself. So the tokenizer encodes each distinct piece of ordinary texts
once, and a text is a join of kept ids. Texts with other characters are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

END_OF_DOCUMENT = 2
PIECES_KEPT = 500_000

# Characters which are their own NFC form, lower to one character, and are letters, digits, blanks or marks to every rule alike.
_LETTER = "a-zß-öø-ÿ"
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_PIECE = re.compile(rf"[{_LETTER}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\s{_LETTER}0-9]+")

# The steps of the file that the pieces above follow.
RULE = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Texts -> little-endian 32-bit ids as bytes."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        # Pieces are lowered and cut here, so they go to the file's merges directly.
        self.merge = self.tokenizer.model.tokenize
        self.by_piece = self._rule() == RULE
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.kept: dict[str, bytes] = {}

    def _rule(self) -> list[str]:
        """Names of the steps before the merges, in order."""
        file = json.loads(self.tokenizer.to_str())
        steps = (file["normalizer"] or {}).get("normalizers", []) + (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        return [step["type"] for step in steps] + [step["pattern"].get("Regex") for step in steps if "pattern" in step]

    @staticmethod
    def byte_level(piece: str) -> str:
        """The characters that stand for a piece's bytes: printing ones for themselves, the others from 256 on."""
        return piece.encode().decode("latin-1").translate(BYTE_LEVEL)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_piece or _UNUSUAL.search(text):
            return self.whole(text)
        pieces = _PIECE.findall(text.lower())
        kept = self.kept
        new = [p for p in set(pieces) if p not in kept]
        if new:
            if len(kept) + len(new) > PIECES_KEPT:
                kept.clear()
                new = list(set(pieces))
            for piece in new:
                kept[piece] = array("I", [t.id for t in self.merge(piece if piece.isascii() else self.byte_level(piece))]).tobytes()
        return b"".join([kept[p] for p in pieces])


def share_words(spark, path: str | None = None):
    """The tokenizer file (a few megabytes) as a broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def word_encoder(shared) -> WordEncoder:
    """The process's encoder for a shared tokenizer file."""
    if not hasattr(shared, "words"):
        shared.words = WordEncoder(shared.value)
    return shared.words
