"""Loops over DataFrames: lineage is cut by checkpoints in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Steps between checkpoints; plans of this many steps are still planned quickly.
EVERY = 3


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; a local session without it gets a temporary folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir():
        return
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="grafmill-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the temporary folder of a local session without it."""
    ensure_checkpoint_dir(spark)
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that read it again and again; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], n: int, stop: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = EVERY) -> DataFrame:
    """Apply ``step`` n times, or until ``stop(old, new)``. Reliable checkpoints survive lost executors."""
    for i in range(n):
        new = step(state, i)
        if stop or (i + 1) % every == 0 and i + 1 < n:
            new = settle(new)
        done = bool(stop and stop(state, new))
        state = new
        if done:
            break
    return state
