"""BPE encoding and decoding for vocabulary files with word ends (`</w>`).

Encoding: a word's symbols form a doubly linked list (arrays ``prev`` and ``next``); a priority queue
holds (merge rank, position) of adjacent pairs. The pair popped is merged when it is still what the
queue said, else skipped as stale; the two new neighbour pairs are pushed. Decoding concatenates
vocabulary strings: this file format has no decoder, so the library puts one space between tokens.

What the tokenizer file does before that (its normalizer and splitting pattern) is done here in the same
order: special tokens are cut out of the raw text, then each stretch is NFC-normalised, lower-cased
character by character and split at white space; no token crosses white space, so words are encoded once
and remembered in a table of bounded size.

Defined results: a null or empty text, or one of white space alone, has no tokens; its digests are those of
the empty string. Repeated rows are encoded each; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grafmill.llm.common import texts

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words remembered by a Python worker; beyond it the table starts anew.
MEMO = 400_000
#: Python's split() also breaks at these, which are no white space to the tokenizer.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class WordBPE:
    """Tokenizer of one vocabulary file. ``words`` maps a normalised word to what ``keep`` makes of its ids."""

    def __init__(self, path: str, keep: Callable[[list[int]], object] = tuple, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        # (left id, right id) -> (rank, id of the two together)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.split = regex.compile(SPLIT)
        self.keep, self.memo = keep, memo
        self.pieces: dict[str, list[int]] = {}
        self.words = _Words(self)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece by the priority queue."""
        raw = piece.encode("utf-8", "surrogatepass")
        symbols = [self.alphabet[b] for b in raw]
        symbols[-1] += self.end
        ids = [self.vocab[s] for s in symbols]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        queue = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)  # by rank, then by the id made, which the rank fixes, then by position
        while queue:
            _, made, i, left, right = heapq.heappop(queue)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i] = made
            alive[j] = False
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (*found, i, made, ids[k]))
            h = prev[i]
            if h >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (*found, h, ids[h], made))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = nxt[i]
        return out

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.split.findall(word):
            ids = self.pieces.get(p)
            if ids is None:
                if len(self.pieces) >= self.memo:
                    self.pieces.clear()
                ids = self.encode_piece(p)
                if len(p) <= 64:
                    self.pieces[p] = ids
            out += ids
        return out

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # str.lower() would make a final sigma of it
            text = text.replace("Σ", "σ")
        return text.lower()

    def stretch(self, text: str) -> list[str]:
        """Words of a stretch without special tokens."""
        text = self.normalize(text)
        return [w for w in _SPACE.split(text) if w] if _NOT_SPACE.search(text) else text.split()

    def encode_kept(self, text: str) -> list:
        """What ``keep`` made of each word's ids, in text order."""
        if "<|" not in text or self.special_at is None:
            return list(map(self.words.__getitem__, self.stretch(text)))
        out: list = []
        for i, part in enumerate(self.special_at.split(text)):
            if i % 2:
                out.append(self.keep([self.special[part]]))
            elif part:
                out += map(self.words.__getitem__, self.stretch(part))
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                for w in self.stretch(part):
                    out += self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class _Words(dict):
    def __init__(self, bpe: WordBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str):
        if len(self) >= self.bpe.memo:
            self.clear()
        kept = self.bpe.keep(self.bpe.encode_word(word))
        if len(word) <= 256:
            self[word] = kept
        return kept


_OPEN: dict[tuple, WordBPE] = {}


def opened(path: str, kind: str, make: Callable[[], WordBPE]) -> WordBPE:
    """One tokenizer for each file and use in a Python worker, kept from task to task."""
    if (path, kind) not in _OPEN:
        _OPEN[path, kind] = make()
    return _OPEN[path, kind]


def _make_text_pair(path: str) -> WordBPE:
    bpe = WordBPE(path)
    bpe.keep = lambda ids: (len(ids), " ".join(map(str, ids)), bpe.decode(ids))
    return bpe


def bpe_round_trip(docs: DataFrame, tokenizer: str, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_text`` also ids and decoded themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(tokenizer, "text pair", lambda: _make_text_pair(tokenizer))
        for b in batches:
            n, ids, decoded, real_ids, real_decoded = [], [], [], [], []
            for text in b.column(1).to_pylist():
                kept = bpe.encode_kept(text)
                counts, numbers, strings = zip(*kept) if kept else ((), (), ())
                a, d = " ".join(numbers), " ".join(strings)
                n.append(sum(counts))
                ids.append(hashlib.sha256(a.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_text:
                    real_ids.append([int(x) for x in a.split()])
                    real_decoded.append(d)
            columns = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_text:
                columns |= {"ids": pa.array(real_ids, pa.list_(pa.int32())), "decoded": pa.array(real_decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    more = ", ids array<int>, decoded string" if keep_text else ""
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
