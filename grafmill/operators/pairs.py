"""Pairs of rows that share a key, whatever the size of a key's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key's block; a task's unit is a pair of blocks.
BLOCK = 2048


def _counted(*frames: DataFrame) -> DataFrame:
    """(key, blocks) of the keys that one block does not hold: at most one row for each BLOCK rows."""
    both = frames[0].select("key")
    for f in frames[1:]:
        both = both.unionByName(f.select("key"))
    n = F.ceil(F.count("*") / F.lit(BLOCK * len(frames))).cast("long")
    return both.groupBy("key").agg(n.alias("blocks")).where("blocks > 1")


def _dealt(rows: DataFrame, large: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with block numbers ``own`` (theirs) and ``other`` (each block of their key)."""
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn(own, F.pmod(F.xxhash64(*(c for c in rows.columns if c not in ("key", "blocks"))), F.col("blocks")))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")


def meet(left: DataFrame, right: DataFrame, condition: Column | str = "true") -> DataFrame:
    """Every row of ``left`` with every one of ``right`` that has its ``key``, where ``condition`` holds.

    A key with many rows is cut into blocks; each pair of blocks is a join key of its own, so no task gets more pairs than
    two blocks make. Rows of keys of one block are not copied. Other columns of the two must not share names.
    """
    large = _counted(left, right)
    return _dealt(left, large, "lo", "hi").join(_dealt(right, large, "hi", "lo"), ["key", "lo", "hi"]).where(condition).drop("lo", "hi")
