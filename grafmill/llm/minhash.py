"""Near-duplicate detection: universal-hash minima, banding, verification, connected components.

1. A text (A-Z lower-cased) becomes the set of its word shingles, each a 64-bit hash; a text with fewer words
   than a shingle is one shingle, a text without words the empty set, linked with nothing. Texts with one and the
   same set are one class from here on, represented by the smallest doc_id.
2. A signature holds the minima of BANDS * ROWS universal hashes; representatives that share a band meet in
   a bucket. At the threshold 0.85 a pair misses all buckets with probability (1 - 0.85**4)**32 < 1e-10.
3. First each text is compared with the smallest id that it shares any bucket with: one pair a text at most. Pairs whose
   signatures are far apart go (the bound lies more than eight standard deviations below the threshold); the rest are
   confirmed on full sets. Links join texts into components.
4. Buckets that still hold several components are compared in full, signatures against signatures, as arrays, larger
   buckets as pairs of blocks; only rows of different components and of like sizes meet. First each text puts forward its
   nearest partner of another component, one pair a text again: copies of one text find it wherever its id stands.
   Rows without a near one need not go further.
   In what is left each near pair is confirmed on full sets where it meets, in the first bucket that it shares, unless
   links found there connect it already; only links leave the task. So no link between components is lost,
   however large the bucket: of two components one at least is not the bucket's largest, and only rows of such ones (seekers)
   look at others. So all rows of a bucket are dealt over blocks once, and seekers go to each of them; where seekers are many,
   they are in blocks too, and pairs of blocks meet. A block holds at most BLOCK rows and about WEIGHT shingles.
5. Links go through alternating large-star and small-star steps, until nothing changes.

What may be missed: a pair at the threshold 0.85 shares no band with probability 6e-11 (at 0.8: 5e-8), and has minima that agree
so little (SLACK) with probability 1e-16 (1e-14); both fall fast with similarity.

Defined results: null text as empty; empty texts are kept, each its own component; equal rows fall into one class;
rows with words that repeat one doc_id are one document (one row each, same verdict): if their texts differ, it is linked with all that
any of them is linked with; a row without doc_id is linked with equal sets alone; texts may be of any length; an empty table
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import materialize, texts
from grafmill.llm.exact_dedup import possible

BANDS, ROWS = 32, 4
#: Rows of a bucket compared in one task at most.
BLOCK = 1024
#: Words whose hashes a Python worker remembers.
MEMO = 200_000
#: Signature agreement below this much under the threshold is no link: over 8 sigma of 128 minima.
SLACK = 0.3
#: Shingles of a block whose sets are compared in one task, about.
WEIGHT = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + n]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    if len(h) < k:
        out += np.uint64(len(h))
    return np.unique(out)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


_A, _B = _coefficients(BANDS * ROWS)


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes a*x + b over 32 mixed bits of each shingle."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        h = _A[:, None] * part[None, :]
        h += _B[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(out, (h * np.uint32(0x2C1B3C6D)).min(1), out=out)
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sigs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _estimated(least: float):
    """Pairs whose signatures agree in at least this share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            keep = np.flatnonzero((a == c).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["a", "b"])

    return run


def _confirmed(k: int, percent: int):
    """Pairs (a, b, text a, text b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            keep = []
            cols = [b.column(i).to_pylist() for i in range(4)]
            for i, (one, _, x, y) in enumerate(zip(*cols, strict=True)):
                if one != last[0]:
                    last = (one, shingles(x, k))
                s, t = last[1], shingles(y, k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (doc_id, component): the smallest id reachable, for every id that reaches a smaller one.

    Large-star: every larger neighbour of u is linked with the smallest id around u; small-star: every smaller
    neighbour too. Both are an aggregate (combined before its shuffle) and a join.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # u > v throughout: the smaller neighbours
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("doc_id"), "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Links need a similarity of at least ``percent`` in 100."""
    docs = texts(docs)
    spark = docs.sparkSession
    signed = materialize(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, set_key binary, sig binary"), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = materialize(signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = members.where("doc_id = rep and n_shingles > 0").select("doc_id").distinct()
    sigs = materialize(signed.select("doc_id", "n_shingles", "set_key", "sig").dropDuplicates(["doc_id", "set_key"]).join(reps, "doc_id"), "representatives")
    links = _links(docs, sigs, k, percent)
    # texts of one doc_id belong together
    told = members.where("n_shingles > 0 and doc_id is not null")
    several = told.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = materialize(told.select("doc_id", F.col("rep").alias("b")).distinct().join(several, "doc_id").where("a <> b").select("a", "b"), "one-id")
    if not same.isEmpty():
        links = same if links is None else links.unionByName(same)
    if links is None:
        component = members.withColumn("component_id", F.col("rep"))
    else:
        component = members.join(components(links).select(F.col("doc_id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return component.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(docs: DataFrame, sigs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Confirmed links, enough to connect all that true links connect; None if there is none."""
    width = 4 * ROWS
    keys = F.array(*(F.xxhash64(F.substring("sig", 1 + width * i, width), F.lit(i)) for i in range(BANDS)))
    bands = sigs.select("doc_id", "n_shingles", F.posexplode(keys).alias("band", "bucket"))
    many = bands.groupBy("bucket").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).where("one <> other")
    # rows of a bucket of their own meet nobody
    bands = materialize(bands.join(many.drop("other"), "bucket"), "buckets")
    # one byte of each minimum: chance agreement of 1 in 256 only raises the estimate
    short = sigs.select("doc_id", F.expr("concat(" + ", ".join(f"substring(sig, {4 * i + 1}, 1)" for i in range(BANDS * ROWS)) + ")").alias("sig"))
    least = percent / 100 - SLACK

    pairs = bands.where("doc_id <> one").groupBy(F.col("doc_id").alias("b")).agg(F.min("one").alias("a")).select("a", "b")
    near = pairs.join(short.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(short.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y")
    near = materialize(near.mapInArrow(_estimated(least), "a long, b long"), "candidates")
    links = materialize(_confirm(docs, near, k, percent), "links")

    rows = _blocks(_mixed(bands, links).join(short, "doc_id"), lambda n, _: n / BLOCK).select(*_KEY, "doc_id", "component", "n_shingles", "sig")
    found = materialize(_dealt(rows).mapInArrow(_by_blocks(_nearest(least, percent)), "bucket long, doc long, partner long, agree int"), "found")
    best = found.where("partner is not null").groupBy("doc").agg(F.max_by("partner", F.struct("agree", -F.col("partner"))).alias("partner"))
    near = materialize(best.select(F.least("doc", "partner").alias("a"), F.greatest("doc", "partner").alias("b")).distinct(), "candidates")
    if not near.isEmpty():
        links = links.unionByName(materialize(_confirm(docs, near, k, percent), "links"))

    # only rows that have a near one of another component in their bucket
    bands = bands.join(found.select("bucket", F.col("doc").alias("doc_id")).distinct(), ["bucket", "doc_id"])
    mixed = _mixed(bands, links)
    sets = possible(docs, mixed.select("doc_id")).mapInArrow(_sets(k), "doc_id long, set_key binary, found binary")
    told = sigs.drop("n_shingles").join(mixed.select("doc_id").distinct(), "doc_id", "left_semi").join(sets, ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"]).drop("set_key")
    rows = _blocks(mixed.join(materialize(told, "sets"), "doc_id"), lambda n, weight: F.greatest(n / (BLOCK // 2), weight / WEIGHT)).select(*_KEY, "doc_id", "component", "n_shingles", "sig", "band", "found")
    links = links.unionByName(materialize(_dealt(rows).mapInArrow(_by_blocks(_linked(least, percent)), "a long, b long"), "links"))
    return None if links.isEmpty() else links


_KEY = ("bucket", "lo", "hi", "seeks")


def _mixed(bands: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, ..., component, seeks) of the buckets that hold several components, with their numbers of rows and
    shingles, ``n`` and ``weight``, and those of the seekers, ``n_seek`` and ``weight_seek``."""
    if links.isEmpty():
        left = bands.withColumn("component", F.col("doc_id"))
    else:
        left = bands.join(components(links), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = materialize(left, "labelled")
    sizes = left.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("w"))
    # the bucket's largest component; a bucket of one has none that seeks
    still = sizes.groupBy("bucket").agg(F.max(F.struct("k", "w", "component")).alias("top"), F.sum("k").alias("n"), F.sum("w").alias("weight")).where(F.col("n") > F.col("top.k"))
    still = still.select("bucket", F.col("top.component").alias("largest"), "n", "weight", (F.col("n") - F.col("top.k")).alias("n_seek"), (F.col("weight") - F.col("top.w")).alias("weight_seek"))
    return materialize(left.join(still, "bucket").withColumn("seeks", F.col("component") != F.col("largest")).drop("largest"), "mixed")


def _blocks(rows: DataFrame, size: Callable[[Column, Column], Column]) -> DataFrame:
    """Each row once for each task (lo, hi) of its bucket that it belongs to: all rows are dealt over blocks hi, seekers also over
    blocks lo; a row goes to its block hi with every lo (seeks: false), a seeker to its block lo with every hi (seeks: true)."""
    count = lambda n, weight: F.greatest(F.lit(1), F.ceil(size(F.col(n), F.col(weight)))).cast("long")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    out = rows.withColumns({"his": count("n", "weight"), "los": count("n_seek", "weight_seek")})
    h = F.xxhash64("doc_id", "bucket")
    # a task of few seekers holds a whole block of rows, one of a whole block of seekers as many rows again
    home = out.withColumns({"hi": F.pmod(h, F.col("his")), "lo": F.explode(spread("los")), "seeks": F.lit(False)})
    seek = out.where("seeks").withColumns({"lo": F.pmod(h, F.col("los")), "hi": F.explode(spread("his"))})
    return home.unionByName(seek)


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, k).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh128_digest(x) if x else None for x in found], pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "set_key", "found"])

    return run


def _by_blocks(compare):
    """Runs ``compare(columns)`` on the rows of each (bucket, lo, hi) that come together; it returns named arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            out = compare(pa.Table.from_batches(group))
            group.clear()
            return pa.RecordBatch.from_pydict({name: x if isinstance(x, pa.Array) else pa.array(x) for name, x in out.items()})

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if group and tuple(key[s]) != last:
                    yield done()
                last = tuple(key[s])
                group.append(b.slice(s, e - s))
        if group:
            yield done()

    return run


class _Block:
    """Rows of one task by size, which of them seek, and which of the others are near a given one."""

    def __init__(self, table: pa.Table, least: float, percent: int, kind: type):
        table = table.combine_chunks()
        n = table["n_shingles"].to_numpy()
        seeks = table["seeks"].to_numpy(zero_copy_only=False)
        order = np.lexsort((n, seeks))  # those looked at first, by size
        self.table, n, seeks = table.take(pa.array(order)), n[order], seeks[order]
        self.doc, self.component = (self.table[c].to_numpy().copy() for c in ("doc_id", "component"))
        self.sig = np.frombuffer(b"".join(self.table["sig"].to_pylist()), kind).reshape(len(n), -1)
        home = n[~seeks]
        # sizes within the threshold's ratio: a stretch of the rows around each one
        self.up, self.down = np.searchsorted(home, n * 100 / percent, "right"), np.searchsorted(home, n * percent / 100, "left")
        self.least, self.seekers = least * self.sig.shape[1], np.flatnonzero(seeks)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of other components near seeker i, nearest first; how many minima agree; where they agree."""
        j = np.arange(self.down[i], self.up[i])
        j = j[self.component[j] != self.component[i]]
        same = self.sig[j] == self.sig[i]
        agree = same.sum(1)
        order = np.lexsort((self.doc[j], -agree))
        order = order[agree[order] >= self.least]
        return j[order], agree[order], same[order]


def _nearest(least: float, percent: int):
    """Each row that has a near one of another component in its bucket; where it looked for it itself, with the nearest."""

    def run(table: pa.Table) -> dict[str, pa.Array]:
        block = _Block(table, least, percent, np.uint8)
        partner, agree = np.full(len(block.doc), -1), np.zeros(len(block.doc), np.int32)
        met = np.zeros(len(block.doc), bool)
        for i in block.seekers:
            j, a, _ = block.near(i)
            if len(j):
                met[i] = met[j] = True
                partner[i], agree[i] = j[0], a[0]
        at = np.flatnonzero(met)
        nobody = partner[at] < 0
        return {"bucket": np.full(len(at), table["bucket"][0].as_py(), np.int64), "doc": block.doc[at], "partner": pa.array(block.doc[partner[at]], mask=nobody), "agree": agree[at]}

    return run


def _linked(least: float, percent: int):
    def run(table: pa.Table) -> dict[str, np.ndarray]:
        block = _Block(table, least, percent, np.uint32)
        band = block.table["band"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in block.table["found"].to_pylist()]
        one, two = [], []
        for i in block.seekers:
            j, _, same = block.near(i)
            # a pair that shares an earlier band meets there
            here = same.reshape(len(j), BANDS, ROWS).all(2).argmax(1) == band
            for x in j[here]:
                if block.component[x] == block.component[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[x]) - both):
                    one.append(min(block.doc[i], block.doc[x]))
                    two.append(max(block.doc[i], block.doc[x]))
                    block.component[block.component == block.component[x]] = block.component[i]
        return {"a": np.array(one, np.int64), "b": np.array(two, np.int64)}

    return run


def _confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    # texts that may be in a pair, told on the scan by a table of fixed size
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    some = possible(docs, ids).select("doc_id", "text")
    one = some.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = some.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    # first the larger id, then the smaller, which many pairs share: pairs of one text come one after the other
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_confirmed(k, percent), "a long, b long").distinct()
