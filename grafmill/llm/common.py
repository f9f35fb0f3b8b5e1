"""Shared helpers: written intermediate tables, column selection and null handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One folder under the shared one for each driver process, so that runs never meet.
RUN = f"grafmill-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a session without ``spark.checkpoint.dir`` (local tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_grafmill_dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="grafmill-")
        atexit.register(shutil.rmtree, base, True)
        sc._grafmill_dir = base
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{RUN}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this driver process; DataFrames built on them can no longer be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) with null texts empty; further columns of the input, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


#: Rows of an Arrow batch: texts can be long, and a Python worker holds a batch as buffers and as strings.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Queries and pipeline stages set this for their session; operators called by themselves leave it as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
