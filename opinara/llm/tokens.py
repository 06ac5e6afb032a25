"""Token ids by the ``tokenizers`` library, with a memory of stretches between spaces.

A text is cut at its single spaces and line breaks, each piece is encoded once and the ids are joined. That gives the library's own
ids as long as no token of the vocabulary reaches across such a space, which holds for the two kinds told apart here:
byte-level vocabularies, where a space belongs to the word after it, and vocabularies that drop white space. Texts in
which a space meets other white space are encoded whole for the first kind. Plain Latin words go straight to the
library's BPE model; every other piece goes through its normaliser and pre-tokenizer. Tests compare the ids with
those of whole texts.
"""

from __future__ import annotations

import struct
from functools import cache
from string import punctuation

#: Pieces remembered per worker and generation; when one is full the older one is dropped.
REMEMBERED = 350_000
# Above this come combining marks and letters whose case or composition depends on their neighbours.
LATIN = "ɐ"


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest moved."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(moved)}


class Pieces(dict):
    """Ids of a piece as bytes, found on first use; None where a piece cannot be encoded by itself."""

    def __init__(self, find, remembered: int):
        super().__init__()
        self.find, self.remembered, self.old = find, remembered, {}

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        known = self.old.get(piece, self)
        ids = self[piece] = self.find(piece) if known is self else known
        return ids


class Encoder:
    """``ids(text)``: the little-endian unsigned 32-bit ids as bytes. Strings of special tokens are plain text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.drops_spaces = self.whole("a") == self.whole(" a")
        self.lowers = self.whole("A") == self.whole("a")
        self.newline = self.whole("\n")
        self.marks = Pieces(self.whole, remembered)
        self.first = Pieces(lambda p: self.piece(p, ""), remembered)
        self.later = self.first if self.drops_spaces else Pieces(lambda p: self.piece(p, " "), remembered)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, before: str, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(self.alphabet[32] + letters if before else letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str, before: str) -> bytes | None:
        if not self.drops_spaces and (piece == "" or piece[0].isspace() or piece[-1].isspace()):
            return None if before or piece else b""
        letters = piece.rstrip(punctuation)
        if letters.isalpha() and (letters.isascii() or max(letters) < LATIN and "İ" not in letters):
            ids = self.word(before, letters.lower() if self.lowers else letters)
            return ids if letters == piece else ids + self.marks[piece[len(letters):]]
        return self.whole(before + piece)

    def line(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, tail))

    def ids(self, text: str) -> bytes:
        try:
            # A single line break is a token of its own, or nothing; several in a row may be one.
            if "\n\n" in text:
                return self.line(text)
            return self.newline.join(map(self.line, text.split("\n")))
        except TypeError:  # a piece is None
            return self.whole(text)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
