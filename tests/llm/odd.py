"""Rows that hold the awkward cases."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} number{i}" for i in range(30_000))
#: Null, empty, white space alone, one word, repeated rows, ties, a very long text, and characters outside ASCII.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "Word"),
    (6, "the same text twice in a row"),
    (7, "the same text twice in a row"),
    (7, "the same text twice in a row"),
    (8, LONG),
    (9, LONG + " end"),
    (10, "ÀÉ ﬁ Σίσυφος 漢字 👩‍👩‍👧 é İstanbul ΟΔΥΣΣΕΥΣ wide space\x1cfs\x85nel"),
    (11, "<|endoftext|> it's <|startoftext|>x 12,345 don't"),
    (12, "a\x00b \x7f"),
]
