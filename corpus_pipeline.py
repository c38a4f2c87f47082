"""A corpus pipeline: quality rules, near-duplicate removal, personal data, source mixing, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and hands what it rereads to the next one. All but the last keep the columns of `documents`.
Stages with Python workers set the session to hand them rows in small batches; it stays so, as run() writes their rows later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import bpe, minhash, mixing, pii, rules
from corvina.llm.common import bitmap, flagged, materialise, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows without an id stay. Rows that repeat an id and a text count once; different texts under one id both
    stay if it is their group's smallest. Only rows that may go, or be repeated, are shuffled.
    """
    small_batches(spark)
    found = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("stays"), F.count("*").alias("rows"))
    touched = materialise(found.where("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("stays").alias("_stays")))
    row = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = flagged(row, "doc_id", bitmap(touched))
    doubtful = marked.where("maybe").join(touched, F.col("doc_id") == F.col("_id"), "left")
    once = doubtful.where("_stays").groupBy("doc_id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    alone = marked.where("not maybe").select("row").union(doubtful.where("_stays is null").select("row"))
    return alone.union(once.select("row")).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars follows the text."""
    return pii.sanitise(docs, size_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tokens approach the target margins."""
    small_batches(spark)
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the bytes that they decode to."""
    small_batches(spark)
    return bpe.encode(docs, decoded=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", quality), ("minhash_near_dedup", dedup), ("pii", private), ("source_mixing", mix), ("byte_bpe", encode)]

#: The near-duplicate, sampling and encoding stages have no SQL form; tests hold their operators against plain versions,
#: and the stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
