"""Neighbourhood and relational prediction over ratings (u, i, r)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafmill.operators import tiles
from grafmill.operators.matrix import block_grid, dense_ids
from grafmill.operators.pairs import meet
from grafmill.plans.iterate import iterate, settle


def cosine(s: dict[str, Column], lam: float) -> Column:
    """Shrunk cosine over co-rated entries; 0 for a zero norm."""
    norm = F.sqrt(s["aa"] * s["bb"])
    return F.when(norm > 0, s["n"] / (s["n"] + lam) * s["ab"] / norm).otherwise(F.lit(0.0))


def pearson(s: dict[str, Column], lam: float) -> Column:
    """Shrunk correlation over co-rated entries; 0 where all of one side are alike."""
    va, vb = s["aa"] - s["a"] * s["a"] / s["n"], s["bb"] - s["b"] * s["b"] / s["n"]
    cov = s["ab"] - s["a"] * s["b"] / s["n"]
    fine = (s["a_least"] < s["a_most"]) & (s["b_least"] < s["b_most"]) & (va > 0) & (vb > 0)
    return F.when(fine, s["n"] / (s["n"] + lam) * cov / F.sqrt(F.when(fine, va * vb).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))


#: Criteria of differences from a mean: ratings are taken from their owner's mean first, so that sums of squares lose no digits.
CENTRED = {"pearson"}
#: Criteria by name; more can be added.
CRITERIA: dict[str, Callable[[dict[str, Column], float], Column]] = {"cosine": cosine, "pearson": pearson}


def inverted_index(ratings: DataFrame, user_base: bool = True) -> DataFrame:
    """(id, entries): item -> its (user, r), or user -> its (item, r), in order."""
    key, other = ("i", "u") if user_base else ("u", "i")
    return ratings.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "r"))).alias("entries"))


def similarities(ratings: DataFrame, criterion: str = "cosine", lam: float = 10.0, user_base: bool = True, max_group: int | None = None) -> DataFrame:
    """(a, b, sim) in both directions for all pairs that rated something in common.

    Sums are combined before the shuffle. A group (an item's raters) of n meets n * (n - 1) / 2 times, as the operator asks, in
    pairs of blocks, so a group of any size is spread over tasks; ``max_group`` leaves out groups larger than that for those who accept it
    (off: nothing is left out).
    """
    own, via = ("u", "i") if user_base else ("i", "u")
    if max_group:
        ratings = ratings.join(ratings.groupBy(via).agg(F.count("*").alias("size")).where(F.col("size") <= max_group).select(via), via, "left_semi")
    if criterion in CENTRED:
        ratings = ratings.join(ratings.groupBy(own).agg(F.avg("r").alias("mean")), own).withColumn("r", F.col("r") - F.col("mean"))
    a = ratings.select(F.col(own).alias("a"), F.col(via).alias("key"), F.col("r").alias("x"))
    b = ratings.select(F.col(own).alias("b"), F.col(via).alias("key"), F.col("r").alias("y"))
    x, y = F.col("x"), F.col("y")
    wanted = {"n": F.count("*").cast("double"), "a": F.sum(x), "b": F.sum(y), "ab": F.sum(x * y), "aa": F.sum(x * x), "bb": F.sum(y * y), "a_least": F.min(x), "a_most": F.max(x), "b_least": F.min(y), "b_most": F.max(y)}
    sums = meet(a, b, "a < b").groupBy("a", "b").agg(*(e.alias(f"s_{name}") for name, e in wanted.items()))
    one = sums.select("a", "b", CRITERIA[criterion]({name: F.col(f"s_{name}") for name in wanted}, lam).alias("sim"))
    return one.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))).alias("x"), "sim").select(F.col("x.p").alias("a"), F.col("x.q").alias("b"), "sim")


def top_neighbours(sims: DataFrame, k: int = 121) -> DataFrame:
    """(a, b, sim, rk): the k most similar, ties by id."""
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return sims.withColumn("sim", F.round("sim", 9) + F.lit(0.0)).withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


#: Pairs meet in matrices if they are more than so many for a rating and no row has more than so many ratings.
MEETINGS, LONGEST = 16, 8192
#: Ratings of a block, rows of a block at least and at most, blocks that give every executor work.
RATINGS, LEAST_ROWS, MOST_ROWS, BLOCKS = 4_000_000, 256, 8192, 24
WHOLE = ("tinyint", "smallint", "int", "bigint")


def nearest(ratings: DataFrame, criterion: str = "cosine", lam: float = 10.0, user_base: bool = True, k: int = 121) -> DataFrame:
    """(a, b, sim, rk): ``top_neighbours`` of ``similarities``, with no row for each pair.

    All pairs are compared, so work grows with the square of the rows. Whole rows are dealt into blocks; two blocks are multiplied as
    matrices in tiles, and of each row the k best of a block go on. What is shuffled is a row's ratings for each block, then k rows for each row and block;
    a task holds two blocks. Where few pairs meet, rows are long, or ratings are not finite, pairs meet one by one.
    """
    own, via = ("u", "i") if user_base else ("i", "u")
    ratings, kinds = settle(ratings.select(own, via, "r")), dict(ratings.dtypes)
    each = ratings.groupBy(own).agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.abs("r") < float("inf"), F.lit(False)), 0).otherwise(1)).alias("odd"))
    rows = each.where(F.col(own).isNotNull()).agg(F.count("*").alias("rows"), F.max("n").alias("longest"), F.sum("n").alias("ratings"), F.sum("odd").alias("odd")).head()
    meetings = ratings.groupBy(via).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).head()[0]
    whole = kinds[own] in WHOLE and kinds[via] in WHOLE and criterion in tiles.CRITERIA
    if not whole or not rows.rows or rows.odd or rows.longest > LONGEST or meetings <= MEETINGS * rows.ratings:
        return top_neighbours(similarities(ratings, criterion, lam, user_base), k)
    size = min(max(rows.rows // BLOCKS, LEAST_ROWS), MOST_ROWS, RATINGS // rows.longest)
    n = -(-rows.rows // size)
    entry = F.struct(F.col(own).cast("long").alias("own"), F.col(via).cast("long").alias("via"), F.col("r").cast("double").alias("r"))
    dealt = ratings.where(F.col(own).isNotNull() & F.col(via).isNotNull()).groupBy(F.pmod(F.xxhash64(F.col(own).cast("long")), F.lit(n)).alias("block")).agg(F.collect_list(entry).alias("x"))
    parts = min(n * (n + 1) // 2, 4096)
    left = dealt.select(F.col("block").alias("lb"), F.explode(F.sequence("block", F.lit(n - 1).cast("long"))).alias("rb"), F.col("x").alias("left"))
    right = dealt.select(F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("lb"), F.col("block").alias("rb"), F.col("x").alias("right"))
    centred = criterion in CENTRED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lb, rb = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                one = tiles.block(batch.column(2)[at].values, centred)
                two = one if lb == rb else tiles.block(batch.column(3)[at].values, centred)
                told = tiles.nearest(one, two, criterion, lam, k, lb == rb)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*told, strict=True)], names=["a", "b", "sim"])

    met = left.repartition(parts, "lb", "rb").join(right.repartition(parts, "lb", "rb"), ["lb", "rb"])
    found = met.mapInArrow(run, "a long, b long, sim double")
    return top_neighbours(found.select(F.col("a").cast(kinds[own]).alias("a"), F.col("b").cast(kinds[own]).alias("b"), "sim"), k)


def predict_rated(neighbours: DataFrame, ratings: DataFrame) -> DataFrame:
    """(u, i, score) for all (user, item) with a neighbour who rated the item: weighted mean."""
    joined = neighbours.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim").join(ratings.select(F.col("u").alias("v"), "i", "r"), "v")
    return joined.groupBy("u", "i").agg(F.sum(F.col("sim") * F.col("r")).alias("sr"), F.sum("sim").alias("s")).select("u", "i", F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col("sr") / F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))).alias("score"))


def predict_all(neighbours: DataFrame, ratings: DataFrame, block: int = 4096) -> DataFrame:
    """(u, i, score) dense: 0.0 where no neighbour rated the item. Users meet items by blocks, never one by one."""
    neighbours = settle(neighbours.select("a", "b", "sim"))  # read twice: for scores and for users
    scores = predict_rated(neighbours, ratings)
    users, items = neighbours.select(F.col("a").alias("u")).distinct(), ratings.select("i").distinct()
    grid = block_grid(users, "u", block, items, "i", block).select(F.explode("left").alias("u"), "right").select("u.u", F.explode("right").alias("i")).select("u", "i.i")
    return grid.join(scores, ["u", "i"], "left").select("u", "i", F.coalesce("score", F.lit(0.0)).alias("score"))


def predict_pairs(neighbours: DataFrame, ratings: DataFrame, pairs: DataFrame, default: float = 0.0) -> DataFrame:
    """(u, i, score) of listed pairs: a neighbour's missing rating counts as ``default``."""
    met = pairs.select("u", "i").join(neighbours.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim"), "u")
    met = met.join(ratings.select(F.col("u").alias("v"), "i", "r"), ["v", "i"], "left")
    sums = met.groupBy("u", "i").agg(F.sum(F.col("sim") * F.coalesce("r", F.lit(default))).alias("sr"), F.sum("sim").alias("s"))
    return sums.select("u", "i", F.coalesce(F.col("sr") / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def sorted_lines(scores: DataFrame) -> DataFrame:
    """(u, line): `item,score;...` ascending by score; scores in millionths."""
    s = F.round(F.col("score") * 1e6).cast("long")
    rows = F.array_sort(F.collect_list(F.struct(s.alias("s"), "i")))
    return scores.groupBy("u").agg(F.concat_ws(";", F.transform(rows, lambda x: F.concat(x["i"].cast("string"), F.lit(","), x["s"].cast("string")))).alias("line"))


#: Items that walk together, as a power of two; sums (of so many items each) that one task may hold; parts of a walk at most.
BITS, SUMS, PARTS = 4, 1 << 20, 32


def relational(edges: DataFrame, interactions: DataFrame, n_items: int, iterations: int, alpha: float) -> DataFrame:
    """(u, i, r): interests walk from the followed to followers, with a uniform restart for what a user already has.

    Items walk in blocks of neighbouring ids, a column each, null where there is no interest, so a link carries a row for each block and
    not for each item. Sums are combined before their shuffle; as a task then holds a sum for nearly every follower, a walk goes
    to one part of the followers after the other. Where ratings are null, items walk one by one.
    """
    interactions = interactions.select("u", "i", "r")
    if not iterations:
        return interactions
    edges, interactions = settle(edges.select("src", "dst")), settle(interactions)
    counts = settle(edges.groupBy("dst").agg(F.count("*").alias("n")))
    if interactions.where("r is null").head(1):
        return _walk_by_items(edges.join(counts, "dst"), interactions, n_items, iterations, alpha)
    kind, names = dict(interactions.dtypes)["i"], None
    if kind in WHOLE:
        given = interactions.withColumn("ix", F.col("i").cast("long"))
    else:
        names = settle(dense_ids(interactions, "i"))
        given = interactions.join(names.withColumnRenamed("id", "i"), "i", "left")
    width = 1 << BITS
    v = [f"v{k}" for k in range(width)]
    # an item that is null has a block of its own
    given = given.select("u", F.shiftright("ix", BITS).alias("block"), F.coalesce(F.col("ix").bitwiseAND(width - 1), F.lit(0)).alias("at"), F.col("r").cast("double").alias("r"))
    own = [F.when(F.col("at") == k, F.col("r")) for k in range(width)]
    restart = [F.when(F.count(c) > 0, F.count(c) * (alpha / n_items)) for c in own]  # a rating that comes twice restarts twice
    x = settle(given.groupBy("u", "block").agg(*(F.sum(c).alias(k) for c, k in zip(own, v, strict=True)), *(c.alias(f"b_{k}") for c, k in zip(restart, v, strict=True))))
    followers = edges.select("src").distinct().count()
    for t in range(iterations):
        back = x.select("u", "block", *((F.col(f"b_{k}") if not t else F.when(F.col(k).isNotNull(), F.lit(alpha / n_items))).alias(k) for k in v))
        leaving = x.join(counts, x["u"] == counts["dst"]).select("dst", "block", *((F.col(k) * (1 - alpha) / F.col("n")).alias(k) for k in v))
        arrived = edges.join(leaving, "dst").select(F.col("src").alias("u"), "block", *v).unionByName(back)
        parts, new = _parts(x, counts, followers), None
        for p in range(parts):
            some = arrived.where(F.pmod(F.xxhash64("u"), F.lit(parts)) == p) if parts > 1 else arrived
            one = some.groupBy("u", "block").agg(*(F.sum(k).alias(k) for k in v))
            new = one if new is None else new.unionByName(one)
        x = settle(new) if t + 1 < iterations else new
    told = x.select("u", "block", F.posexplode(F.array(*v)).alias("at", "r")).where("r is not null")
    told = told.select("u", F.shiftleft("block", BITS).bitwiseOR(F.col("at").cast("long")).alias("ix"), "r")
    if names is None:
        return told.select("u", F.col("ix").cast(kind).alias("i"), "r")
    return told.join(names, "ix", "left").select("u", F.col("id").alias("i"), "r")


def _parts(x: DataFrame, counts: DataFrame, followers: int) -> int:
    """Parts of the followers for which a walk makes no more than ``SUMS`` sums each."""
    most = followers * x.select("block").distinct().count()
    if most > SUMS:  # where interests are few, what is sent bounds it
        sent = x.groupBy(F.col("u").alias("dst")).agg(F.count("*").alias("blocks")).join(counts, "dst").agg(F.sum(F.col("n") * F.col("blocks"))).head()[0]
        most = min(most, sent or 0)
    return max(1, min(PARTS, -(-most // SUMS)))


def _walk_by_items(links: DataFrame, interactions: DataFrame, n_items: int, iterations: int, alpha: float) -> DataFrame:
    """The same with a row for each link and item; null ratings restart and add nothing."""
    links = settle(links)

    def step(x: DataFrame, _: int) -> DataFrame:
        sent = links.join(x.withColumnRenamed("u", "dst"), "dst").select(F.col("src").alias("u"), "i", (F.col("r") * (1 - alpha) / F.col("n")).alias("r"))
        back = x.select("u", "i", F.lit(alpha / n_items).alias("r"))
        return sent.unionByName(back).groupBy("u", "i").agg(F.sum("r").alias("r"))

    return iterate(interactions, step, iterations)
