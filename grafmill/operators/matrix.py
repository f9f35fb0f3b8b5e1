"""Distributed matrix products and dense re-indexing of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafmill.functions import vec
from grafmill.plans.iterate import settle


#: Rows and columns of a block of a dense product.
SIDE = 256


def dense_dense(a: DataFrame, b: DataFrame) -> DataFrame:
    """A (id, x) times B (id, x), B's id being A's position in x: entries (i, j, c).

    Blocks of A (rows by inner index) meet blocks of B (inner index by columns) and are multiplied as matrices; sums over the inner
    blocks follow. So a small inner dimension does not bound the number of tasks: these are (rows / SIDE) * (columns / SIDE) as well.
    """
    cut = lambda m, own, along: m.select(F.col("id").alias(own), F.posexplode(F.expr(f"transform(sequence(0, greatest(size(x) - 1, 0) div {SIDE}), k -> slice(x, k * {SIDE} + 1, {SIDE}))")).alias(along, "x"))
    left, n = in_blocks(cut(a.where(F.size("x") > 0), "i", "kb"), "i", SIDE)
    left = left.groupBy(F.col("block").alias("ib"), "kb").agg(F.collect_list(F.struct("i", "x")).alias("left"))
    right = cut(b.where(F.size("x") > 0), "k", "jb").groupBy(F.floor(F.col("k") / SIDE).cast("int").alias("kb"), "jb").agg(F.collect_list(F.struct((F.col("k") % SIDE).cast("int").alias("k"), "x")).alias("right"))
    # each block of B goes to all row blocks of A: its key is (row block, inner block)
    spread = right.join(F.broadcast(n)).withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")  # n: one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one, jb, two in zip(pdf["left"], pdf["jb"], pdf["right"], strict=True):
                p = np.stack([r["x"] for r in one])
                q = np.zeros((p.shape[1], max(len(r["x"]) for r in two)))
                for r in two:
                    if r["k"] < len(q):
                        q[r["k"], : len(r["x"])] = r["x"]
                yield pd.DataFrame({"i": [r["i"] for r in one], "jb": jb, "c": list(p @ q)})

    parts = left.join(spread, ["ib", "kb"]).select("left", "jb", "right").mapInPandas(run, "i long, jb int, c array<double>")
    each = parts.select("i", "jb", F.posexplode("c").alias("j", "c")).groupBy("i", (F.col("jb") * SIDE + F.col("j")).cast("long").alias("j"))
    return each.agg(F.sum("c").alias("c"))


def transpose_times(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """AᵀB of two matrices with the same ids: entries (i, j, c). One row meets one row; partial sums before the shuffle."""
    both = a.select("id", F.col("x").alias("p")).join(b.select("id", F.col("x").alias("q")), "id")
    scaled = both.select(F.posexplode("p").alias("i", "y"), "q").select("i", vec.scale(F.col("q"), F.col("y")).alias("z"))
    return scaled.groupBy("i").agg(vec.vsum("z", width).alias("c")).select(F.col("i").cast("long").alias("i"), F.posexplode("c").alias("j", "c")).select("i", F.col("j").cast("long").alias("j"), "c")


def sparse_dense(a: DataFrame, b: DataFrame, d: int) -> DataFrame:
    """A (k, id, val) and B (id = k, x): out[id] = sum of val * B[k], as (id, x)."""
    joined = a.join(b.select(F.col("id").alias("k"), F.col("x").alias("row")), "k")
    return joined.select(a["id"], vec.scale(F.col("row"), F.col("val")).alias("z")).groupBy("id").agg(vec.vsum("z", d).alias("x"))


def in_blocks(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by hash over blocks of about ``size`` (``block``), and one row (``blocks``) with their number."""
    n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("blocks"))
    return rows.join(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks"), n


def block_grid(left: DataFrame, left_key: str, left_size: int, right: DataFrame, right_key: str, right_size: int) -> DataFrame:
    """(left, right): blocks of rows, as arrays of structs, each of the one side with each of the other.

    For operators whose result is every row with every row: both sides are dealt by hash into blocks, so tasks are pairs of
    blocks, and no row is copied oftener than the other side has blocks.
    """
    one, n = in_blocks(left, left_key, left_size)
    two, m = in_blocks(right, right_key, right_size)
    all_of = lambda df, name, block: df.groupBy(F.col("block").alias(block)).agg(F.collect_list(F.struct(*(c for c in df.columns if c != "block"))).alias(name))
    every = lambda df, number, block: df.join(F.broadcast(number)).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")  # noqa: E731 (one row)
    return every(all_of(one, "left", "lb"), m, "rb").join(every(all_of(two, "right", "rb"), n, "lb"), ["lb", "rb"]).select("left", "right")


def dense_ids(ids: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """(id, ix): distinct ids of any type, in order, numbered from 0. Ids are dealt over ranges with sampled bounds, numbered
    within each, and over the ranges' counts, so no task sees all ids, however they are spread."""
    n = parts or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = settle(ids.select(F.col(column).alias("id")).where("id is not null").distinct())  # read twice: for bounds, then to be dealt
    dealt = settle(distinct.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    return local.join(before, "part").select("id", (F.col("before") + F.col("at") - 1).cast("long").alias("ix"))
