"""Labelled documents for the classifiers: the fold rule and the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key has none."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, key: str = "doc_id") -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents outside the held-out fold, chosen by a hash of the key.

    Only keys are sorted for the choice; then the chosen texts are read. Null labels are left out.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IS NOT NULL")
    chosen = known.where(remainder(F.col("id"), folds) != 0).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
