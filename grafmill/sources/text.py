"""Readers and writers of the text formats, and parsers of the raw logs. Lines that do not parse are left out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafmill.plans.iterate import shared_folder

RATINGS = T.StructType([T.StructField("u", T.LongType()), T.StructField("i", T.LongType()), T.StructField("r", T.DoubleType())])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
TENSOR = T.StructType([T.StructField("x", T.StringType()), T.StructField("p", T.LongType()), T.StructField("q", T.LongType()), T.StructField("o", T.LongType()), T.StructField("r", T.DoubleType())])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """`user,item[,rating]`: a missing rating is 0.0."""
    return spark.read.schema(RATINGS).csv(path, mode="PERMISSIVE").where("u is not null and i is not null").fillna(0.0, ["r"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).csv(path, sep="\t", mode="DROPMALFORMED").where("src is not null and dst is not null")


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TENSOR).csv(path, mode="DROPMALFORMED").drop("x")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """`id,x0,x1,...` -> (id, x)."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].cast("double").cast("long").alias("id"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("x"))


def write_matrix(matrix: DataFrame, path: str, mode: str = "overwrite") -> None:
    matrix.select(F.concat_ws(",", F.col("id").cast("string"), F.col("x").cast("array<string>")).alias("value")).write.mode(mode).text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """`id,b` -> (id, x): a bias or any other number of each id, as an array of one."""
    return read_matrix(spark, path)


def append_matrix(matrix: DataFrame, path: str) -> None:
    write_matrix(matrix, path, "append")


def joined_vector(x: str = "x") -> Column:
    """An array as `x0,x1,...`."""
    return F.concat_ws(",", F.col(x).cast("array<string>"))


def joined_rows(rows: str = "rows") -> Column:
    """A matrix (array of arrays) flattened to `x00,x01,...`."""
    return F.concat_ws(",", F.flatten(rows).cast("array<string>"))


def seed_row(spark: SparkSession, node: int, value: float = 0.0) -> DataFrame:
    """One (id, dist) row to start a search from."""
    return spark.range(1).select(F.lit(node).cast("long").alias("id"), F.lit(float(value)).alias("dist"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_text(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=sep)


def write_binary(df: DataFrame, path: str, codec: str = "gzip", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", codec).parquet(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_copy(spark: SparkSession, source: str, target: str, delete_source: bool = False) -> None:
    """All lines under ``source`` in one file under ``target``; one task writes it, as one file asks. ``delete_source`` makes it a move."""
    spark.read.text(source).coalesce(1).write.mode("overwrite").text(target)
    if delete_source:
        remove(spark, source)


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder under another name: nothing is read or written where the file system can rename."""
    fs, at = _file(spark, source)
    if not fs.rename(at, _file(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return bool(fs.exists(at))


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def tagged_union(**frames: DataFrame) -> DataFrame:
    """Rows of several inputs, each with its name as ``tag``."""
    out = None
    for tag, df in frames.items():
        df = df.withColumn("tag", F.lit(tag))
        out = df if out is None else out.unionByName(df)
    return out


def parse_im(lines: DataFrame) -> DataFrame:
    """`a;b;flag,...` -> (src, dst): only rows flagged 1 whose ids begin with a digit."""
    p = F.split("value", ";")
    rows = lines.where(F.size(p) >= 3).select(F.trim(p[0]).alias("a"), F.trim(p[1]).alias("b"), F.split(p[2], ",")[0].alias("flag"))
    return rows.where("flag = '1'").where(F.col("a").rlike("^[0-9]") & F.col("b").rlike("^[0-9]")).select(F.expr("try_cast(a as bigint)").alias("src"), F.expr("try_cast(b as bigint)").alias("dst"))


def parse_microblog(lines: DataFrame) -> DataFrame:
    p = F.split("value", "\t")
    return lines.where(F.size(p) >= 2).select(p[0].alias("a"), p[1].alias("b")).select(F.expr("try_cast(a as bigint)").alias("src"), F.expr("try_cast(b as bigint)").alias("dst"))


def parse_userinfo(lines: DataFrame) -> DataFrame:
    """`ignored,id,f0,f1,...` -> (id, k, f): blank features are left out."""
    p = F.split("value", ",", -1)
    rows = lines.where(F.size(p) >= 2).select(F.expr("try_cast(split(value, ',')[1] as bigint)").alias("id"), F.posexplode(p).alias("at", "f"))
    return rows.where("at >= 2 and trim(f) <> ''").select("id", (F.col("at") - 2).cast("long").alias("k"), F.trim("f").alias("f"))


def trim_keys(lines: DataFrame, n: int = 2) -> DataFrame:
    """Drop the last n characters of each line's first field."""
    key = F.substring_index("value", ",", 1)
    rest = F.expr("substring(value, length(substring_index(value, ',', 1)) + 1)")
    return lines.select(F.concat(F.expr(f"substring(substring_index(value, ',', 1), 1, greatest(length(substring_index(value, ',', 1)) - {n}, 0))"), rest).alias("value"), key.alias("key"))
