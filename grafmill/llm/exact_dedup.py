"""Exact deduplication by composable polynomial fingerprints.

A text's bytes are hashed in chunks, ``h(c) = sum(c[i] * B**(len-1-i)) mod p``, for two primes below
2**31, and chunk hashes combine by shifting: ``h(x + y) = h(x) * B**len(y) + h(y)``. So the chunks of a
huge text can be hashed anywhere, in any order, and the fingerprint depends on the whole text alone: texts above HUGE
code points are cut into rows of that size, which tasks hash in parallel, and an aggregate combines them.
Texts with equal (fingerprint, length) are then compared chunk by chunk: the least and the greatest chunk at
each place of a group, kept while rows stream by and combined before the shuffle, must be one and the same.
Where they are not, the group's texts are told apart by digest. Only texts of groups are read again: a bit
table of fixed size (BITS words, whatever the corpus) tells on the scan which rows can be in one.

Defined results: a null text is the empty text; all empty texts are one group; of equal texts the row
with the largest doc_id stays; of rows that repeat that doc_id with that text one stays (they are alike, so any); a
doc_id with several texts has a verdict for each; a row without doc_id comes after all others; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import materialize, texts

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 14
#: Code points in a row of the comparison; longer texts are compared in several rows.
COMPARE = 1 << 18
#: Texts of more code points are hashed in rows of that many each.
HUGE = 1 << 22
SALTS = 16
#: 64-bit words of the bit table: 2 MB, broadcast. A full table lets more rows pass, never fewer.
BITS = 1 << 18


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(n - 2, -1, -1):
        out[i] = int(out[i + 1]) * base % prime
    return out


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def chunk_hash(chunk: bytes, which: int = 0) -> int:
    """Fingerprint of one chunk of at most CHUNK bytes. A leading 1 is not needed: lengths are compared too."""
    key = (BASES[which], PRIMES[which])
    if key not in _POWERS:
        _POWERS[key] = _powers(*key, CHUNK)
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    # below 2**8 * 2**31 * 2**14: a sum never overflows 64 bits
    return int(np.dot(data, _POWERS[key][CHUNK - len(chunk) :])) % PRIMES[which]


def combine(left: int, right: int, right_len: int, which: int = 0) -> int:
    """Fingerprint of ``x + y`` from those of x and y and y's length."""
    return (left * pow(BASES[which], right_len, PRIMES[which]) + right) % PRIMES[which]


def fingerprint(data: bytes) -> int:
    """62 bits: both primes' hashes of the whole text, chunk hashes combined."""
    both = []
    for which in (0, 1):
        h = 0
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            h = combine(h, chunk_hash(part, which), len(part), which)
        both.append(h)
    return both[0] << 31 | both[1]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h) -> META."""
    for b in batches:
        raw = [x.encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([fingerprint(x) for x in raw], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())],
            names=["doc_id", "h", "fp", "n_bytes", "text_sha256"],
        )


META = "doc_id long, h long, fp long, n_bytes long, text_sha256 string"


def _chunk_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., chunk) -> (..., fp, shift of each prime, n_bytes)."""
    for b in batches:
        last = b.num_columns - 1
        raw = [x.encode("utf-8", "surrogatepass") for x in b.column(last).to_pylist()]
        shifts = [pa.array([pow(BASES[i], len(x), PRIMES[i]) for x in raw], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(last)), pa.array([fingerprint(x) for x in raw], pa.int64()), *shifts, pa.array([len(x) for x in raw], pa.int64())],
            names=[*b.schema.names[:last], "fp", "s0", "s1", "n_bytes"],
        )


def _of_huge(docs: DataFrame) -> DataFrame:
    """META and ``m``, how many rows are alike, of texts hashed in several rows."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.length("text") / F.lit(HUGE)).cast("int")
    cut = (
        docs.withColumns({"text_sha256": F.sha2("text", 256), "part": F.explode(F.sequence(F.lit(0), parts - 1))})
        .select("doc_id", "h", "text_sha256", "part", F.expr(f"substring(text, part * {HUGE} + 1, {HUGE})").alias("chunk"))
        .repartition(n, "h", "part")
        .mapInArrow(_chunk_fingerprints, "doc_id long, h long, text_sha256 string, part int, fp long, s0 long, s1 long, n_bytes long")
    )
    key = ["doc_id", "h", "text_sha256"]
    each = cut.groupBy(*key, "part").agg(F.min("fp").alias("fp"), F.min("s0").alias("s0"), F.min("s1").alias("s1"), F.min("n_bytes").alias("n_bytes"), F.count("*").alias("m"))
    # a row for each HUGE code points of one text
    whole = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "fp", "s0", "s1"))).alias("x"), F.sum("n_bytes").alias("n_bytes"), F.min("m").alias("m"))
    low = (1 << 31) - 1
    fold = lambda take, shift, prime: f"aggregate(x, 0L, (a, c) -> (a * c.{shift} + {take}) % {prime})"
    fp = F.expr(f"shiftleft({fold('shiftright(c.fp, 31)', 's0', PRIMES[0])}, 31) | {fold(f'(c.fp & {low}L)', 's1', PRIMES[1])}")
    return whole.select("doc_id", "h", fp.alias("fp"), "n_bytes", "text_sha256", "m")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = texts(docs).withColumn("h", F.xxhash64("text"))
    huge = F.length("text") > HUGE
    meta = docs.where(~huge).mapInArrow(_fingerprints, META).withColumn("m", F.lit(1).cast("long")).unionByName(_of_huge(docs.where(huge)))
    # rows alike become one with their number, so a text repeated under one doc_id, or under none, is no hot group
    meta = materialize(meta.groupBy("doc_id", "h", "fp", "n_bytes", "text_sha256").agg(F.sum("m").alias("m")), "fingerprints")
    key = ["fp", "n_bytes"]
    groups = lambda: meta.groupBy(*key).agg(F.sum("m").alias("n"), F.max("doc_id").alias("keep_id")).where("n > 1")
    shared = groups()
    # each large group is dealt over SALTS tasks (more where adaptive execution splits them)
    salt = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS))
    salted = lambda g: g.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    members = materialize(meta.select("h", *key).distinct().join(shared, key).select("h"), "members")
    uneven = materialize(_uneven(docs, members), "uneven")
    if not uneven.isEmpty():
        meta = meta.join(uneven.withColumn("apart", F.lit(True)), key, "left").withColumn("apart", F.when(F.col("apart"), F.col("text_sha256")).otherwise(""))
        key = [*key, "apart"]
        shared = groups()
    out = meta.withColumn("salt", salt).join(salted(shared), [*key, "salt"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    # one of the rows alike may stay
    each = out.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return each.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("k") == 1)).alias("kept"), "text_sha256")


def _bit(column: str, salt: int) -> tuple:
    """Word and bit of the table for a value."""
    h = F.xxhash64(column, F.lit(salt))
    return F.pmod(h, F.lit(BITS)), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({column}, {salt}), 32), 64) as int))")


def flagged(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` with ``maybe``: whether ``column`` may be in that of ``ids``, decided on the scan; BITS rows are broadcast at most."""
    word, bit = _bit(column, 7)
    table = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(table), "word", "left")
    return found.withColumn("maybe", F.expr("coalesce(bits & bit <> 0, false)")).drop("word", "bit", "bits")


def possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``ids``."""
    return flagged(docs, ids).where("maybe").drop("maybe")


def _uneven(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(fp, n_bytes) of groups whose texts are not all the same, compared in chunks of COMPARE code points.

    Rows that may be in a group are hashed once more where they are read, so their texts meet in an aggregate alone.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(COMPARE))).cast("int")
    some = flagged(docs, members, "h").where("maybe").select("text")
    chunks = (
        some.mapInArrow(_with_fingerprint, "fp long, n_bytes long, text string")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("fp", "n_bytes", "part", F.expr(f"substring(text, part * {COMPARE} + 1, {COMPARE})").alias("chunk"))
    )
    return chunks.groupBy("fp", "n_bytes", "part").agg(F.min("chunk").alias("a"), F.max("chunk").alias("z")).where("a <> z").select("fp", "n_bytes").distinct()


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [x.encode("utf-8", "surrogatepass") for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in raw], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), b.column(0)], names=["fp", "n_bytes", "text"])
