"""Graph operators over edges (src, dst[, w]): ranking, search, diameter, statistics, building blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.plans.iterate import iterate, settle


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def link_counts(edges: DataFrame, side: str = "src") -> DataFrame:
    """(id, n): links of each node; ``side`` src counts out-links, dst in-links."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))


def _transition(edges: DataFrame) -> DataFrame:
    """(src, dst, p): weight over number of out-links."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.join(link_counts(edges).withColumnRenamed("id", "src"), "src").select("src", "dst", (w / F.col("n")).alias("p"))


def uniform_importance(ids: DataFrame, channels: int = 1) -> DataFrame:
    """(id, v): 1/N in each channel."""
    n = ids.agg(F.count("*").alias("n"))
    return ids.join(F.broadcast(n)).select("id", F.array_repeat(F.lit(1.0) / F.col("n"), channels).alias("v"))  # n: one row


def dense_importance(values: DataFrame, channels: int) -> DataFrame:
    """(id, k, v) -> (id, v array): channels without a value are 0."""
    slot = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0))
    return values.groupBy("id").agg(F.array(*map(slot, range(channels))).alias("v"))


def pagerank(edges: DataFrame, iterations: int = 100, alpha: float = 0.9, channels: int = 1, restart: DataFrame | None = None, start: DataFrame | None = None, tol: float | None = None) -> DataFrame:
    """(id, v): p'(a) = alpha * sum p(b) * w / links(b) + (1 - alpha) * restart(a). Mass of nodes without out-links is dropped.

    ``restart`` and ``start`` are (id, v); uniform if not given, 0 for nodes they lack. With ``tol`` the walk ends early, once no
    number of a step moves by more than that.
    """
    ids = settle(nodes(edges))
    even = uniform_importance(ids, channels)
    zero = F.array_repeat(F.lit(0.0), channels)
    dense = lambda d: ids.join(d, "id", "left").select("id", F.coalesce("v", zero).alias("v")) if d is not None else even
    back = dense(restart).withColumnRenamed("v", "back")
    step_of = settle(_transition(edges))

    def step(ranks: DataFrame, _: int) -> DataFrame:
        sent = step_of.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), vec.scale(F.col("v"), F.col("p")).alias("x"))
        got = sent.groupBy("id").agg(vec.vsum("x", channels).alias("x"))
        return back.join(got, "id", "left").select("id", vec.axpy(vec.scale(F.col("back"), 1 - alpha), alpha, F.coalesce("x", zero)).alias("v"))

    def still(old: DataFrame, new: DataFrame) -> bool:
        moved = new.join(old.select("id", F.col("v").alias("before")), "id").select(F.array_max(F.zip_with("v", "before", lambda a, b: F.abs(a - b))).alias("d"))
        return (moved.agg(F.max("d").alias("d")).head().d or 0.0) <= tol

    return iterate(dense(start), step, iterations, stop=still if tol is not None else None)


def missing(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(n): links whose source has no vector; ranking drops them."""
    return edges.join(vectors.select(F.col("id").alias("src")), "src", "left_anti").agg(F.count("*").alias("n"))


def hits(edges: DataFrame, iterations: int, alpha: float = 0.9, normalize: bool = False) -> DataFrame:
    """(id, authority, hub): authorities from hubs along the links, then hubs from authorities against them."""
    ids = settle(nodes(edges))
    forth, back = settle(_transition(edges)), settle(_transition(reverse(edges)))

    def half(via: DataFrame, of: DataFrame) -> DataFrame:
        got = via.join(of.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.sum(F.col("x") * F.col("p")) * alpha).alias("x"))
        got = ids.join(got, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))
        if normalize:
            norm = got.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            got = got.join(F.broadcast(norm)).select("id", F.coalesce(F.try_divide("x", "norm"), F.lit(0.0)).alias("x"))  # one row
        return got

    def step(state: DataFrame, _: int) -> DataFrame:
        a = half(forth, state.select("id", F.col("hub").alias("x")))
        h = half(back, a)
        return a.withColumnRenamed("x", "authority").join(h.withColumnRenamed("x", "hub"), "id")

    start = uniform_importance(ids).select("id", F.col("v")[0].alias("authority"), F.col("v")[0].alias("hub"))
    return iterate(start, step, iterations)


def shortest_paths(edges: DataFrame, source: int, iterations: int) -> DataFrame:
    """(id, dist): cheapest way of at most ``iterations`` links; a link without w costs 1. Each round goes on from the nodes
    that got cheaper in the one before; it ends when there are none."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    links = settle(edges.select("src", "dst", w.cast("double").alias("w")))
    start = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))

    def step(state: DataFrame, _: int) -> DataFrame:
        front = state.where("fresh").select(F.col("id").alias("src"), "dist")
        reached = links.join(front, "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(None).cast("double").alias("before"))
        best = state.select("id", "dist", F.col("dist").alias("before")).unionByName(reached).groupBy("id").agg(F.min("dist").alias("dist"), F.min("before").alias("before"))
        return best.select("id", "dist", (F.col("before").isNull() | (F.col("dist") < F.col("before"))).alias("fresh"))

    return iterate(start, step, iterations, stop=lambda old, new: new.where("fresh").isEmpty()).select("id", "dist")


def hops(edges: DataFrame, source: int, most: int) -> DataFrame:
    """(id, hops) of all nodes within ``most`` links; stops when a round reaches nobody new."""
    links = settle(edges.select("src", "dst").distinct())
    start = edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(0).cast("long").alias("hops"))

    def step(seen: DataFrame, i: int) -> DataFrame:
        front = seen.where(F.col("hops") == i).select(F.col("id").alias("src"))
        new = links.join(front, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        return seen.unionByName(new.select("id", F.lit(i + 1).cast("long").alias("hops")))

    return iterate(start, step, most, stop=lambda old, new: old.count() == new.count())


def reachable(edges: DataFrame, a: int, b: int, most: int = 100) -> float | None:
    """Hop distance from a to b, None beyond ``most``."""
    row = hops(edges, a, most).where(F.col("id") == b).head()
    return float(row.hops) if row else None


def expand_reverse(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Nodes from which a seed is reached in at most ``rounds`` links, seeds included: (id)."""
    links = settle(edges.select("src", "dst"))

    def step(found: DataFrame, _: int) -> DataFrame:
        before = links.join(found.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        return found.unionByName(before).distinct()

    return iterate(seeds.select("id").distinct(), step, rounds)


def expand_band(edges: DataFrame, seeds: DataFrame, rounds: int, lower: int, upper: int) -> DataFrame:
    """(id, n): nodes y with lower <= links from the set into y + [y in the set] <= upper, ``rounds`` times."""
    links = settle(edges.select("src", "dst"))

    def step(found: DataFrame, _: int) -> DataFrame:
        hit = links.join(found.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
        both = hit.unionByName(found.select("id"))
        return both.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n").between(lower, upper))

    start = seeds.select("id").distinct().withColumn("n", F.lit(1).cast("long"))
    return iterate(start, step, rounds)


BITS = 32


def sketch(ids: DataFrame) -> DataFrame:
    """(id, mask): one bit each, at the number of trailing zeros of the id's 32-bit fold."""
    fold = F.col("id").bitwiseXOR(F.shiftrightunsigned("id", 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    at = F.least(vec.trailing_zeros(fold).cast("int"), F.lit(BITS - 1))
    return ids.select("id", F.expr("1L").alias("one"), at.alias("at")).select("id", F.expr("shiftleft(one, at)").alias("mask"))


def sketch_step(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks of nodes and of all they link to, by bitwise or."""
    seen = edges.select("src", "dst").join(masks.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "mask")
    return masks.unionByName(seen).groupBy("id").agg(F.bit_or("mask").alias("mask"))


def sketch_size() -> Column:
    """Estimate of the number of reachable (node, node) pairs, as an aggregate of ``mask``."""
    return F.sum(F.pow(F.lit(2.0), vec.lowest_zero(F.col("mask")).cast("double")) / F.lit(0.77351))


def sketch_sizes(edges: DataFrame, most: int, in_neighbours: bool = False) -> Iterator[float]:
    """The neighbourhood function for h = 0, 1, ... most, a number at a time; a step is taken when its number is asked for."""
    edges = settle(edges.select("src", "dst"))
    ids = nodes(edges)
    masks = sketch(ids)
    if in_neighbours:
        got = edges.join(masks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.bit_or("mask").alias("mask"))
        masks = ids.join(got, "id", "left").select("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    for h in range(most + 1):
        if h:
            masks = settle(sketch_step(edges, masks))
        yield masks.agg(F.coalesce(sketch_size(), F.lit(0.0)).alias("n")).head().n


def neighbourhood(edges: DataFrame, most: int, in_neighbours: bool = False) -> DataFrame:
    """(h, n): the neighbourhood function for h = 0..most. ``in_neighbours``: nodes start with the bits of those that link
    to them instead of their own."""
    return edges.sparkSession.createDataFrame(list(enumerate(sketch_sizes(edges, most, in_neighbours))), "h long, n double")


def effective_diameter(edges: DataFrame, most: int, eps: float = 0.001) -> DataFrame:
    """(diameter, n): the first h with N(h) * (1 + eps) > N(h + 1), or ``most``. No step is taken beyond h + 1."""
    sizes = sketch_sizes(edges, most)
    now = next(sizes)
    h = 0
    for ahead in sizes:
        if now * (1 + eps) > ahead:
            break
        h, now = h + 1, ahead
    return edges.sparkSession.createDataFrame([(h, now)], "diameter long, n double")


def degree_distribution(edges: DataFrame, side: str) -> DataFrame:
    """(degree, nodes)."""
    return link_counts(edges, side).groupBy(F.col("n").alias("degree")).agg(F.count("*").alias("nodes"))


def adjacency(edges: DataFrame, side: str = "src") -> DataFrame:
    """(id, nbrs): links of each node with weights, in order. One row holds a node's links."""
    other = "dst" if side == "src" else "src"
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.groupBy(F.col(side).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), w.alias("w")))).alias("nbrs"))


def from_adjacency(lists: DataFrame) -> DataFrame:
    """(id, nbrs) -> edges (src, dst, w)."""
    return lists.select(F.col("id").alias("src"), F.explode("nbrs").alias("x")).select("src", F.col("x.id").alias("dst"), F.col("x.w").alias("w"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    kept = ids.select("id").distinct()
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
