"""Heartbeats as an append-only log beside a snapshot of states: they renew a lease's silence and never move a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.queue import OPEN
from voxloom.sources.snapshots import Snapshots, Version

BEATS = "assignment bigint, at double"


def beaten(state: Snapshots, rows: DataFrame, source: str, batch: int) -> Version:
    """Appends a batch of heartbeats (assignment, at in seconds) of assignments that are open in the state's table `states`; others are dropped.

    A batch that comes again changes nothing, and rows of one assignment in a batch become the latest one.
    """
    latest = rows.groupBy("assignment").agg(F.max("at").cast("double").alias("at"))

    def change(now: Version) -> tuple[dict, dict]:
        still = state.read("states", now).where(F.col("state").isin(*OPEN)).select("assignment")
        return {}, {"beats": latest.join(still, "assignment", "left_semi")}

    return state.update(change, source, batch)


def heard(state: Snapshots) -> DataFrame:
    """(assignment, heard): the last heartbeat of each assignment that had one."""
    log = state.read("beats")
    log = state.spark.createDataFrame([], BEATS) if log is None else log
    return log.groupBy("assignment").agg(F.max("at").alias("heard"))
