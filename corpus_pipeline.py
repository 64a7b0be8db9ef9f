"""Cleaning and tokenising a corpus in five stages, each written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, decontaminate, neardup, queries, secrets, toxicity
from voxloom.llm.labelled import training_sample
from voxloom.llm.store import small_batches, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples do not vote them toxic; rows with a null id or text, and repeated ones, are judged alike."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.trained(training_sample(docs, labels, "toxic", queries.TOXICITY_SAMPLE))
    return toxicity.scored(docs, index, out="_toxicity").where("_toxicity.score < 0.5").select(docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of rows with one id, one; null ids all stay."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null texts stay."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark; n_chars follows the text. All rows stay, null texts as they are."""
    found = secrets.scanned(docs, queries.secret_ratios(spark, docs, sf_dir), out="_secrets")
    changed = F.when(F.size("_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return secrets.redacted(found, "_secrets").withColumn("n_chars", changed).select(docs.columns)


def tokens_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian unsigned 32-bit integers) in place of the text, and digests."""
    small_batches(spark)
    out = bpe.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), out="_tokens")
    return out.select(
        *[c for c in docs.columns if c != "text"],
        (F.octet_length("_tokens.ids") / 4).cast("bigint").alias("n_tokens"),
        F.col("_tokens.ids").alias("ids"),
        F.sha2("_tokens.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", copies_out),
    ("decontamination", benchmark_out),
    ("secrets", secrets_out),
    ("tokens", tokens_in),
]

#: The stages learn from labels and link documents transitively, which one SQL query cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
