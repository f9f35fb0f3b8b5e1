"""Training-text pipeline: toxicity, exact duplicates, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever else these are. A null text counts as empty. Rows that
repeat a doc_id are judged each by its text for toxicity and exact copies, together for near copies; a row without doc_id
is judged like others, and comes after them where one of several stays. An empty table passes through; texts may be of any length.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafmill.llm import exact_dedup, minhash, packing, pii, toxicity
from grafmill.llm.common import materialize, shared_dir, small_batches
from grafmill.llm.exact_dedup import flagged

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _without(rows: DataFrame, gone: DataFrame, near: str = "key") -> DataFrame:
    """``rows`` (key, row, ...) whose key is not in ``gone`` (key, ...).

    A table of fixed size tells on the scan, by the column ``near`` of both, which rows may be in it; only these are shuffled.
    """
    told = flagged(rows, gone, near)
    left = told.where("maybe").join(gone.select("key"), "key", "left_anti")
    return told.where("not maybe").unionByName(left).drop("maybe")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # a row's key is its doc_id, if it has one, and its text's digest
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256")
    told = materialize(exact_dedup.exact_dedup(docs).where("group_size > 1").select(key.alias("key"), "text_sha256", "kept"), "copies")
    by_key = materialize(told.groupBy("key", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("n")), "keys")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.struct(*docs.columns).alias("row"))
    rows = _without(rows.select(key.alias("key"), "text_sha256", "row"), by_key.where("not stays"), "text_sha256")
    alike = by_key.where("stays and n > 1")
    if not alike.isEmpty():
        # rows alike in doc_id and text: one of them stays
        one = rows.join(alike.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by("row", F.to_json("row")).alias("row"))
        rows = _without(rows, alike, "text_sha256").select("key", "row").unionByName(one)
    return rows.select("row.*")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # rows without doc_id get one from their text, above those in use, so that others stay before them
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    key = F.coalesce(F.col("doc_id").cast("long"), own)
    gone = materialize(minhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("key")).distinct(), "gone")
    return _without(docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")), gone).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; texts without any stay as they are."""
    small_batches(spark)
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.best_fit_packing(docs, WORD_BPE)


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("near_dedup", remove_near_copies), ("pii", redact), ("packing", pack)]

#: Trained models and tokenizers stand behind the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
