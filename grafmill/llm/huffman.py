"""Token ids in a binary format: canonical length-limited Huffman coding.

Writing: documents are tokenised once into an intermediate table (the tokenizers library's ids, see ENGINES); Spark
counts all ids; code lengths of at most LIMIT bits come from the package-merge method on these counts (one number for each
id of the vocabulary, so a fixed bound), codes are canonical: by (length, id). Rows are dealt over ranges of (doc_id, row)
and coded in blocks of at most BLOCK ids; a document longer than that goes over several blocks. A block is independent of
others: it holds its bits, the bit offset of every STEP-th id (checkpoints) and its documents' ids, numbers of ids and bit offsets.
Files are Parquet rows (part, block, ...) in ascending doc_id order, beside a table of code lengths.

Reading: a table of 2**LIMIT entries maps the next bits to (id, length). All checkpoints of a block are decoded
in step with each other, so the work is array arithmetic. Long documents are joined from their stretches.

Defined results: a null or empty text is the end id alone; rows of one doc_id are written each and follow each other, by
number of ids, then by their checksum; rows without doc_id come first; a text may be of any length;
an empty table gives an empty file set and an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafmill.llm.common import materialize, texts
from grafmill.llm.library import Library
from grafmill.llm.word_bpe import byte_alphabet, opened

LIMIT = 18
STEP = 256
BLOCK = 1 << 18
#: Ids of a part, about, where a shuffle's usual number of parts would make them larger; a part is a stream of blocks, so its size takes no memory.
PART = 1 << 27
#: Fixed values of byte-level vocabulary files: the splitting pattern, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No piece of PATTERN goes over the border of one of these, and none depends on what is outside.
_UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def byte_library(path: str) -> Library:
    """Byte-level BPE of a vocabulary file, by the tokenizers library."""
    return opened(path, "bytes", lambda: Library(path, _UNIT.findall, regex.compile(PATTERN).findall, int(_kind(vocabulary_size(path))[2])))


class Ranked:
    """The same ids from tiktoken, in less than half of the time: ids of such a file stand in merge order, so they serve as ranks.

    Texts in which a special token occurs go to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.library = byte_library(path)
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = self.library.whole.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if t not in self.library.special}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.packed = self.library.packed

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            yield next(self.library.encode([t])) if any(s in t for s in self.library.special) else self.packed(self.core.encode_ordinary(t))


ENGINES = {"tokenizers": byte_library, "tiktoken": lambda path: opened(path, "ranked", lambda: Ranked(path))}


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, engine: str = "tiktoken") -> DataFrame:
    """(doc_id, n, ids): ids as little-endian unsigned integers of two bytes (four if the vocabulary is larger)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = ENGINES[engine](tokenizer)
        end = lib.packed([end_id])
        for b in batches:
            out = [x + end for x in lib.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // len(end) for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, ids binary")


def _kind(n_vocab: int) -> str:
    return "<u2" if n_vocab <= 1 << 16 else "<u4"


def counts(tokens: DataFrame, n_vocab: int) -> np.ndarray:
    """How often each id occurs: counted in each task, then added up; one row for each id at most."""
    kind = _kind(n_vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocab, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, kind), minlength=n_vocab) if len(raw) > 4 * n_vocab else 0
                if len(raw) <= 4 * n_vocab:
                    found, k = np.unique(np.frombuffer(raw, kind), return_counts=True)
                    total[found] += k
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    out = np.zeros(n_vocab, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.lexsort((used, weights[used]))]
    leaf = weights[order].astype(np.float64 if weights.sum() > 1 << 61 else np.int64)
    packages = np.zeros(0, leaf.dtype)
    levels = []
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        sorted_by = np.argsort(both, kind="stable")
        levels.append(sorted_by < n)  # which of the merged list are leaves
        merged = both[sorted_by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: codes of one length follow each other in id order."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    ls = lengths[order].astype(np.int64)
    for size in np.unique(ls):
        code <<= int(size) - last
        own = order[ls == size]
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(size)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each value of the next ``limit`` bits: id * 32 + code length."""
    codes = canonical(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.zeros(1 << limit, np.int64)
    spans = 1 << (limit - lengths[order].astype(np.int64))
    starts = codes[order].astype(np.int64) << (limit - lengths[order].astype(np.int64))
    if len(order):
        table[starts[0] : starts[0] + spans.sum()] = np.repeat(order.astype(np.int64) * 32 + lengths[order], spans)
    return table


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits, first to last, on whole bytes; and the bit at which each id begins."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    n_words = int(ends[-1] + 31) // 32 + 1 if len(ids) else 1
    # each code goes to the word in which it begins and, where it crosses, to the next; sums of disjoint bits below 2**53
    shifted = codes[ids].astype(np.uint64) << (64 - (begins & 31) - size).astype(np.uint64)
    word = begins >> 5
    flow = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n_words)
    flow += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words + 1)[:n_words]
    return flow.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8 if len(ids) else 0], begins


def decode_bits(data: bytes, begins: np.ndarray, numbers: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of all stretches, one after the other: stretch i begins at bit begins[i] and has numbers[i] ids."""
    raw = np.frombuffer(data + b"\0" * (12 - len(data) % 4), ">u4").astype(np.uint64)
    windows = raw[:-1] << np.uint64(32) | raw[1:]
    total = int(numbers.sum())
    out = np.zeros(total, np.int64)
    at, to = begins.astype(np.int64).copy(), np.cumsum(numbers) - numbers
    order = np.argsort(-numbers, kind="stable")  # longest first, so that those still running are a prefix
    at, to, numbers = at[order], to[order], numbers[order]
    mask = np.uint64((1 << limit) - 1)
    for k in range(int(numbers.max(initial=0))):
        run = int(np.searchsorted(-numbers, -k, "left"))
        here = at[:run]
        entry = table[(windows[here >> 5] >> (64 - limit - (here & 31)).astype(np.uint64) & mask).astype(np.int64)]
        out[to[:run] + k] = entry >> 5
        at[:run] += entry & 31
    return out


BLOCKS = "part int, block int, doc_ids array<long>, rows array<long>, numbers array<int>, doc_bits array<long>, firsts array<boolean>, checkpoints array<long>, payload binary, n_ids long"
_KINDS = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64())


def write(tokens: DataFrame, lengths: np.ndarray, n_vocab: int, parts: int) -> DataFrame:
    """``tokens`` (doc_id, n, crc, row, ids) as blocks in the shared folder; part p's rows come before part p + 1's."""
    kind, codes, order = _kind(n_vocab), canonical(lengths), ["doc_id", "n", "crc", "row"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # doc_id, row, whether its first stretch, ids
        n_held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[3] for h in held])
            data, begins = encode_bits(ids, codes, lengths)
            numbers = np.array([len(h[3]) for h in held])
            row = (part, block, [h[0] for h in held], [h[1] for h in held], numbers, begins[np.cumsum(numbers) - numbers], [h[2] for h in held], begins[::STEP], data, len(ids))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            for doc, own, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(raw, kind)
                for at in range(0, len(ids), BLOCK):
                    stretch = ids[at : at + BLOCK]
                    if held and n_held + len(stretch) > BLOCK:
                        yield flush()
                        block, n_held = block + 1, 0
                    held.append((doc, own, at == 0, stretch))
                    n_held += len(stretch)
        if held:
            yield flush()

    # by rows, not by doc_id alone: one that very many rows share is spread as well
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "row", "ids")
    return materialize(dealt.mapInArrow(code, BLOCKS), "token-blocks", "uncompressed")


def _decoded(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch for each block."""
    table = decode_table(lengths)
    for b in batches:
        for r in b.to_pylist():
            numbers, marks = np.array(r["numbers"], np.int64), np.array(r["checkpoints"], np.int64)
            each = np.minimum(STEP, r["n_ids"] - STEP * np.arange(len(marks)))
            ids = decode_bits(r["payload"], marks, each, table).astype("<u4")
            ends = np.cumsum(numbers)
            parts = [ids[e - n : e].tobytes() for n, e in zip(numbers, ends, strict=True)]
            n = len(parts)
            arrays = [pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["rows"], pa.int64()), pa.array(r["firsts"], pa.bool_()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "place", "doc_id", "row", "first", "ids"])


def read(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(part, block, place, doc_id, row, first, ids): the stretches of documents, decoded. ids: little-endian unsigned 32-bit."""
    return blocks.mapInArrow(lambda batches: _decoded(batches, lengths), "part int, block int, place int, doc_id long, row long, first boolean, ids binary")


def crc32_combine(a: int, b: int, len_b: int) -> int:
    """CRC of x + y from those of x and y and y's length in bytes."""

    def times(mat: list[int], vec: int) -> int:
        out, i = 0, 0
        while vec:
            if vec & 1:
                out ^= mat[i]
            vec >>= 1
            i += 1
        return out

    op = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    n = 8 * len_b
    while n:
        if n & 1:
            a = times(op, a)
        op = [times(op, x) for x in op]
        n >>= 1
    return a ^ b


def huffman_file(docs: DataFrame, tokenizer: str, end_id: int = 2, parts: int | None = None, engine: str = "tiktoken") -> tuple[DataFrame, np.ndarray]:
    """Write all documents; (blocks, code lengths) are what read() takes."""
    spark = docs.sparkSession
    n_vocab = vocabulary_size(tokenizer)
    # a row's number is written with it, so it is the same whenever a task runs again
    tokens = materialize(tokenize(docs, tokenizer, end_id, engine).withColumns({"crc": F.crc32("ids"), "row": F.monotonically_increasing_id()}), "tokens")
    seen = counts(tokens, n_vocab)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(seen.sum()) // PART)
    lengths = code_lengths(seen)
    return write(tokens, lengths, n_vocab, parts), lengths


def digests(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    # ids before each part and, in it, before each block: one small row a block, summed in two steps
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before_part"))
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before_block")).join(totals, "part").select("part", "block", (F.col("before_part") + F.col("before_block")).alias("before"))
    placed = materialize(_crc(blocks, lengths), "stretches").join(starts, ["part", "block"]).withColumn("start", F.col("before") + F.col("inside"))
    # a document's first stretch of BLOCK ids may go on in the next block; only such documents are gathered, each row by itself
    whole = placed.where("first and n < %d" % BLOCK).select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = placed.where("not (first and n < %d)" % BLOCK)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """The stretches of one document longer than a block, in order."""
        rows = list(pdf.sort_values("start").itertuples())
        n, crc = rows[0].n, rows[0].crc
        for r in rows[1:]:
            n, crc = n + r.n, crc32_combine(crc, r.crc, 4 * r.n)
        return pd.DataFrame({"doc_id": pd.array([rows[0].doc_id], "Int64"), "start": [rows[0].start], "n_tokens": [n], "ids_crc32": [crc]})

    return whole.unionByName(cut.groupBy("row").applyInPandas(join, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _crc(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Each stretch's number of ids, CRC and the ids before it in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decoded(batches, lengths):
            raw = b.column(6).to_pylist()
            n = np.array([len(x) // 4 for x in raw], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 3, 4, 5)), pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.cumsum(n) - n)], names=["part", "block", "doc_id", "row", "first", "n", "crc", "inside"])

    return blocks.mapInArrow(run, "part int, block int, doc_id long, row long, first boolean, n long, crc long, inside long")


def huffman_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, parts: int | None = None, engine: str = "tiktoken") -> DataFrame:
    return digests(*huffman_file(docs, tokenizer, end_id, parts, engine))
