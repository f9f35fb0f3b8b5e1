"""Tokenizing operators against the tokenizers library, and exact round trips."""

import brute
import numpy as np
import pytest
from odd import LONG, ODD

from grafmill.llm import huffman, packing, word_bpe

BYTE, WORD = (brute.public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_engines_agree(spark, frame):
    one, two = (sorted(map(tuple, huffman.tokenize(frame(ODD), BYTE, 2, e).collect())) for e in huffman.ENGINES)
    assert one == two


@pytest.fixture(params=["all", "odd"])
def rows(request, documents):
    return documents if request.param == "all" else ODD


def test_huffman(spark, frame, rows):
    got = sorted(tuple(r) for r in huffman.huffman_round_trip(frame(rows), BYTE).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute.huffman(rows))


def test_huffman_many_blocks(spark, frame, monkeypatch):
    """Documents longer than a block, cut at its borders."""
    rows = [(i, LONG[: 3000 * i]) for i in range(12)]
    monkeypatch.setattr(huffman, "BLOCK", 1024)
    got = sorted(tuple(r) for r in huffman.huffman_round_trip(frame(rows), BYTE, parts=3).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute.huffman(rows))


def test_huffman_rows_of_one_id(spark, frame, monkeypatch):
    """Rows that repeat an id, or have none, with texts longer than a block: each whole, one after the other."""
    rows = [(1, LONG[:9000]), (1, LONG[:9000]), (1, "short"), (2, LONG[:20_000]), (2, LONG[:19_000]), (2, None)]
    monkeypatch.setattr(huffman, "BLOCK", 1024)
    got = sorted(tuple(r) for r in huffman.huffman_round_trip(frame(rows), BYTE, parts=3).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute.huffman(rows)
    got = [tuple(r) for r in huffman.huffman_round_trip(frame([(None, "x"), (3, "y"), (None, LONG[:9000])]), BYTE, parts=2).collect()]
    assert sorted((r[1], r[0], r[2]) for r in got)[-1][1] == 3 and sorted(r[0] or 0 for r in got) == [0, 0, 3]


def test_units_as_the_library_makes_them():
    """The library's ids of whole texts, made of pieces: all kinds of white space, marks and letters."""
    import random

    rng = random.Random(3)
    pool = [*"abcXYZ019'.,-  \n\t\r", "'s", "'ll", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "é", "\u0301", "漢", "ﬁ", "İ", "🙂", "\u200d", "²", "Σ", "<|", "|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + [" " * 5000, "x" * 5000, "\n" * 99 + "y", "a <|endoftext|> b", *(t or "" for _, t in ODD)]
    vocab = list(brute.opened("byte_bpe_50k.json").get_vocab())
    texts += ["".join(rng.choices(vocab, k=3)).replace("Ġ", " ") for _ in range(5000)]
    for path, lib, width in ((BYTE, huffman.byte_library(BYTE), "<u2"), (BYTE, huffman.Ranked(BYTE), "<u2"), (WORD, packing.word_library(WORD), "<u4")):
        whole = brute.opened(path.rsplit("/", 1)[1])
        for t, e, got in zip(texts, whole.encode_batch(texts, add_special_tokens=False), lib.encode(texts), strict=True):
            assert np.frombuffer(got, width).tolist() == e.ids, (path, t)


def test_bpe(spark, frame, rows):
    got = sorted(tuple(r) for r in word_bpe.bpe_round_trip(frame(rows), WORD).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute.bpe(rows)


def test_packing(spark, frame, rows):
    out = packing.best_fit_packing(frame(rows), WORD).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == brute.cut(rows)
    check_places(out)


def check_places(out, capacity=4096):
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("operator", [lambda d: huffman.huffman_round_trip(d, BYTE), lambda d: word_bpe.bpe_round_trip(d, WORD), lambda d: packing.best_fit_packing(d, WORD)])
def test_empty_table(spark, frame, operator):
    assert operator(frame([])).count() == 0


def best_fit_decreasing(lengths, capacity=4096):
    """Number of sequences, piece by piece."""
    from bisect import bisect_left, insort

    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        room = capacity if k == len(rooms) else rooms.pop(k)
        insort(rooms, room - x)
    return len(rooms)


LENGTHS = {  # and how far above the lower bound the plan may be
    "lognormal 7.2": (lambda rng: rng.lognormal(7.2, 0.7, 20_000), None),
    "lognormal 6": (lambda rng: rng.lognormal(6, 0.9, 20_000), 1.001),
    "uniform 700-2100": (lambda rng: rng.integers(700, 2101, 20_000), 1.02),
    "uniform 1000-3000": (lambda rng: rng.integers(1000, 3001, 20_000), None),
    "uniform 600-1500": (lambda rng: rng.integers(600, 1501, 20_000), 1.02),
    "three sizes": (lambda rng: rng.choice([1366, 1365, 2731], 20_000), 1.35),
    "one size": (lambda rng: np.full(5000, 1500), None),
    "full and small": (lambda rng: rng.choice([4096, 1, 7], 5000), 1.001),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plan(name):
    """Every piece has one place, places are gapless, and there are never more sequences than best fit decreasing makes."""
    make, most = LENGTHS[name]
    lengths = np.clip(make(np.random.default_rng(7)).astype(int), 1, 4096)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    ranks, held = {k: [] for k in counts}, {}
    for length, rank, n, first, offset in packing.plan(counts):
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            held.setdefault(s, []).append((offset, length))
    assert all(sorted(x) == list(range(counts[k])) for k, x in ranks.items())
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    bound, plain = -(-int(lengths.sum()) // 4096), best_fit_decreasing(lengths.tolist())
    print(name, len(held), plain, bound)
    assert len(held) <= plain and (most is None or len(held) <= most * bound + 1)


def test_configurations_are_optimal():
    """Values of the linear program on a case that is known: 3 of 1365, or 1 of 2731 and 1 of 1365, fill a sequence."""
    chosen = packing.configurations([1365, 2731], [3000, 600], 4096)
    assert sum(n for _, n in chosen) == 600 + 800 and all(np.dot(u, [1365, 2731]) <= 4096 for u, _ in chosen)


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(0)
    weights = rng.integers(0, 1000, 300)
    lengths = huffman.code_lengths(weights, 18)
    heap = [int(w) for w in weights if w]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (weights * lengths).sum() == cost  # no limit in the way
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array(fibonacci), 12)
    assert lengths.max() == 12 and sum(2.0 ** -int(x) for x in lengths) == 1


def test_bits_round_trip():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 50_000) % 5000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5000))
    data, begins = huffman.encode_bits(ids, huffman.canonical(lengths), lengths)
    table = huffman.decode_table(lengths)
    marks = np.arange(0, len(ids), huffman.STEP)
    numbers = np.diff([*marks, len(ids)])
    assert (huffman.decode_bits(data, begins[marks], numbers, table) == ids).all()


def test_crc_combine():
    import zlib

    a, b = b"hello " * 99, b"world" * 1234
    assert huffman.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
