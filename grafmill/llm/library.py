"""Ids of the tokenizers library, asked for once for each piece that a worker remembers.

A text is cut into units (runs without white space, as a rule) whose ids do not depend on what stands around them, a unit
not yet known into the pieces that the file's pattern makes of it, and a piece not yet known goes to the library's model.
Texts in which a special token occurs go to the library whole. What is remembered is bounded: two tables of at most MEMO
entries, the older one dropped when the younger is full.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator

from grafmill.llm.word_bpe import byte_alphabet

#: Units, and pieces, remembered by a Python worker in each of two tables; longer strings than LONG are not remembered.
MEMO, LONG = 250_000, 256


class _Recent(dict):
    """What was asked for lately: string -> ids as bytes."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > LONG:
                return out
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Library:
    """``units`` cuts a text (its normalisation included), ``pieces`` a unit; ``width`` is the size of an id in bytes."""

    def __init__(self, path: str, units: Callable[[str], list[str]], pieces: Callable[[str], list[str]], width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.kind = self.whole.model, {2: "H", 4: "I"}[width]
        self.printable = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.units, self.pieces = units, pieces
        self.known_pieces = _Recent(self._piece)
        self.known = _Recent(self._unit)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):  # the model reads bytes in their printable form
            piece = piece.encode().decode("latin-1").translate(self.printable)
        return self.packed([t.id for t in self.model.tokenize(piece)])

    def _unit(self, unit: str) -> bytes:
        if (unit[1:] if unit[0] == " " else unit).isalpha():  # letters are one piece, with the space before them
            return self._piece(unit)
        return b"".join(map(self.known_pieces.__getitem__, self.pieces(unit)))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, little-endian."""
        for t in texts:
            if any(s in t for s in self.special):
                yield self.packed(self.whole.encode(t, add_special_tokens=False).ids)
            else:
                yield b"".join(map(self.known.__getitem__, self.units(t)))
