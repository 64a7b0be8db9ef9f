"""Scores that arrive after the work they score: two streams joined within a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.policy import DUPLICATE, GOLD, SamplingPolicy


def scored_stream(submissions: DataFrame, scores: DataFrame, within: str = "7 days", delay: str = "1 hour", p: SamplingPolicy | None = None) -> DataFrame:
    """(key, submitted, kind, score, needs_review): a row for each score of a submission, or one without once none can come any more.

    submissions: a stream (key, submitted timestamp, kind, flagged); scores: a stream (key, scored timestamp, score). A score
    counts from the submission on for the span `within`; both streams may be late by `delay`, and a
    submission waits in the state no longer than both together. A score below its kind's threshold raises the flag and no
    score lowers it: of several rows of a key, any that needs review decides. A null key has no score.
    """
    p = p or SamplingPolicy()
    work = submissions.withWatermark("submitted", delay)
    found = scores.select(F.col("key").alias("_key"), "scored", "score").withWatermark("scored", delay)
    span = F.expr(f"interval {within}")
    same = (F.col("key") == F.col("_key")) & (F.col("scored") >= F.col("submitted")) & (F.col("scored") <= F.col("submitted") + span)
    low = ((F.col("kind") == GOLD) & (F.col("score") < p.gold_dice_flag)) | ((F.col("kind") == DUPLICATE) & (F.col("score") < p.duplicate_dice_flag))
    joined = work.join(found, same, "left_outer")
    return joined.select("key", "submitted", "kind", "score", (F.col("flagged") | F.coalesce(low, F.lit(False))).alias("needs_review"))
