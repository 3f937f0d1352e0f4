"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs the
stages writes each result as Parquet and gives it to the next one, reread. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, lines, mix, sketches, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; labels of held-out rows are never learned from."""
    scored = toxicity.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    return scored.where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without globally repeated runs of two lines or more; one whose whole text was a repetition goes."""
    out = lines.dedup(docs, modulus=2, grow=True)
    left = (F.col("removed") == 0) | F.col("text").rlike(r"\S")
    return out.where(F.col("text").isNull() | left).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    found = sketches.near_duplicates(docs, words=5, similarity=0.8)
    extra = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them, dealt out by shard in shuffled order."""
    return mix.shuffled(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    tok = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    made = docs.select("doc_id", "source", tok.round_trip(F.col("text")).alias("r"))
    return made.select("doc_id", "source", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids", "r.ids_sha256", "r.decoded_sha256")


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Learned scores, rolling hashes, components and permuted draws have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each result but the last is written under spark.checkpoint.dir and reread."""
    from driftline.session import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
