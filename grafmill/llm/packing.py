"""Best-fit packing of tokenised documents into sequences, after a linear grouping scheme.

1. Each document is tokenised by the tokenizers library (an end id is appended) and cut, only if longer than a sequence, into pieces.
2. Spark counts the pieces of each length: at most ``capacity`` numbers, whatever the corpus' size. All
   planning works on these counts, on the driver.
3. Linear grouping: the large lengths, in order, fall into groups of equal numbers of pieces, each rounded
   up to its group's largest length. Configurations over these few sizes (how many pieces of each size a
   sequence takes) are optimised as a linear program: columns come from a knapsack on the duals, until none lowers the
   number of sequences. Each configuration is used as often as its value says, rounded down.
4. The real pieces, of the group's own lengths, take the places of the rounded ones.
5. All other pieces go, largest first, by best fit to the room that is left, in bulk: sequences alike in room are
   one entry (room, how many), so the work depends on the number of lengths, not of pieces.
   Best fit alone, without configurations, is planned too; the plan of fewer sequences is taken, so none is worse than that.
6. The plan says, for each length, which ranks go to which sequences; each piece finds its place from
   its rank among pieces of its length. Ranks come from a window over (length, bucket) and sums over buckets,
   so pieces of one common length are dealt over many tasks, the more pieces the more.

Defined results: a null or empty text is the end id alone; a text may be of any length; repeated rows are packed each (their
ranks differ by row order within ties, which does not matter: they are equal); an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafmill.llm.common import materialize, texts
from grafmill.llm.library import Library
from grafmill.llm.word_bpe import WordBPE, opened

CAPACITY = 4096
#: Groups of the linear grouping, and the share of a sequence from which a piece is large.
GROUPS = 96
LARGE = 1 / 8
#: Columns that the linear program takes up for each group, at most; it is as good as optimal long before.
COLUMNS = 40
#: Buckets of a length, at least, and its pieces in a bucket, about.
BUCKETS, IN_BUCKET = 256, 1_000_000


def word_library(path: str) -> Library:
    """BPE with word ends of a vocabulary file, by the tokenizers library; words are normalised and cut as the file says."""

    def make() -> Library:
        bpe = WordBPE(path)
        return Library(path, bpe.stretch, bpe.split.findall, 4)

    return opened(path, "library", make)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row for each piece of each document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = word_library(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), lib.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def group_lengths(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Large lengths, ascending, cut into at most ``groups`` runs of about equal numbers of pieces."""
    total, out, seen = sum(counts.values()), [], 0
    for length in sorted(counts):
        if not out or seen >= total * len(out) / groups:
            out.append([])
        out[-1].append(length)
        seen += counts[length]
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that pieces in one sequence can have, and how many of each size that takes."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i in np.flatnonzero(worth > 1e-12):
        size = int(sizes[i])
        for _ in range(capacity // size):
            new = best[:-size] + worth[i]
            better = new > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = new[better]
            last[size:][better] = i
    use, at = np.zeros(len(sizes), np.int64), int(best.argmax())
    while last[at] >= 0:
        use[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(worth @ use), use


def configurations(sizes: list[int], numbers: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, how many sequences) of the linear program min sum x, A x >= numbers, rounded down."""
    size, need, m = np.array(sizes), np.array(numbers, float), len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // size[i]) for i in range(m)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for step in range(COLUMNS * m):
        worth, use = best_configuration(size, inverse.sum(0), capacity)
        if worth <= 1 + 1e-7:
            break
        d = inverse @ use
        ratios = np.full(m, np.inf)
        np.divide(x, d, out=ratios, where=d > 1e-9)
        out = int(ratios.argmin())
        columns[out] = use
        if step % 50 == 49:
            inverse = np.linalg.inv(np.stack(columns, 1))
        else:
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
        x = np.maximum(inverse @ need, 0)
    times = np.floor(x + 1e-9).astype(np.int64)
    return [(c.tolist(), int(n)) for c, n in zip(columns, times, strict=True) if n]


class _Plan:
    """Rows (length, first rank, how many, first sequence, offset), and the rooms left: (room, first sequence, how many)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.rooms: list[tuple[int, int, int]] = []  # ascending
        self.sequences = 0

    def place(self, length: int, n: int, first: int, offset: int) -> None:
        self.rows.append((length, self.used[length], n, first, offset))
        self.used[length] += n
        self.left[length] -= n

    def configured(self, runs: list[list[int]], chosen: list[tuple[list[int], int]]) -> None:
        """Each place of a configuration takes real pieces of its group, largest first; stretches alike become one entry."""
        for use, times in chosen:
            times = min([times, *(sum(self.left[k] for k in runs[i]) // n for i, n in enumerate(use) if n)])
            entries = [(self.sequences, times, 0)] if times else []
            self.sequences += times
            for i in sorted(range(len(use)), reverse=True):
                for _ in range(use[i]):
                    after = []
                    for first, many, offset in entries:
                        while many:
                            length = next(k for k in reversed(runs[i]) if self.left[k])
                            take = min(many, self.left[length])
                            self.place(length, take, first, offset)
                            after.append((first, take, offset + length))
                            first, many = first + take, many - take
                    entries = after
            for first, many, offset in entries:
                if offset < self.capacity:
                    insort(self.rooms, (self.capacity - offset, first, many))

    def best_fit(self) -> None:
        """What is left, largest first: a piece goes to the smallest room that takes it."""
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                k = bisect_left(self.rooms, (length, -1, -1))
                if k == len(self.rooms):
                    new = -(-n // (self.capacity // length))
                    insort(self.rooms, (self.capacity, self.sequences, new))
                    self.sequences += new
                    continue
                room, first, many = self.rooms.pop(k)
                # a sequence takes as many of them as it holds before the next one gets any
                per = room // length
                full = min(many, n // per)
                for j in range(per if full else 0):
                    self.place(length, full, first, self.capacity - room + j * length)
                rest = n - full * per if full < many else 0
                for j in range(rest):
                    self.place(length, 1, first + full, self.capacity - room + j * length)
                for room_left, at, k in ((room - per * length, first, full), (room - rest * length, first + full, int(rest > 0)), (room, first + full + (rest > 0), many - full - (rest > 0))):
                    if room_left and k:
                        insort(self.rooms, (room_left, at, k))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, how many, first sequence, offset): rank first + k goes to sequence first + k."""
    plain = _Plan(counts, capacity)
    plain.best_fit()
    big = {k: n for k, n in counts.items() if capacity * large < k < capacity}
    if not big or plain.sequences == -(-sum(k * n for k, n in counts.items()) // capacity):
        return plain.rows
    runs = group_lengths(big, groups)
    grouped = _Plan(counts, capacity)
    grouped.configured(runs, configurations([r[-1] for r in runs], [sum(big[k] for k in r) for r in runs], capacity))
    grouped.best_fit()
    return min((plain, grouped), key=lambda p: p.sequences).rows


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, buckets: int = BUCKETS) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ...) with sequence_id and offset. ``cut`` is read three times."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(buckets, max(counts.values(), default=0) // IN_BUCKET)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    rows = sorted(plan(counts, capacity, groups))
    lengths = np.array([r[0] for r in rows], np.int64)
    firsts = np.array([r[1] for r in rows], np.int64)
    sequence = np.array([r[3] for r in rows], np.int64)
    offsets = np.array([r[4] for r in rows], np.int64)
    keys = lengths * (1 << 48) + firsts  # ranks of a length stay below 2**48

    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = keyed.withColumn("local", local).join(before.drop("n"), ["length", "bucket"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("local") - 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        at = np.searchsorted(keys, length.to_numpy() * (1 << 48) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - firsts[at], "offset": offsets[at]})

    return ranked.select(*cut.columns, place("length", "rank").alias("at")).select(*cut.columns, "at.sequence_id", "at.offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
