"""Leases that run out in silence: timers of processing time, so an assignment expires though no event comes any more.

Where streaming/leases.py follows event time, which only other events move, these timers follow the
clock of the cluster. An assignment's open lease is one state value with an expiry of its own, and a snapshot
of open leases can stand at the stream's beginning. Needs the RocksDB state store (see `stored`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxloom.functions.policy import SamplingPolicy
from voxloom.streaming.leases import CLOSING, OPENING, OUT, STATE, ends


class Leases(StatefulProcessor):
    """One value an assignment, (assigned, heard) in seconds, and one timer at the end of its lease."""

    def __init__(self, policy: SamplingPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = int((self.policy.lease_days + 1) * 86_400_000)  # no lease lives longer, so nothing is left behind
        self.lease = handle.getValueState("lease", STATE, keep)

    def _armed(self, assigned: float, heard: float | None, now: int) -> None:
        """Keeps the lease, with its only timer at its end or at once if that has passed."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.lease.update((assigned, heard))
        self.handle.registerTimer(max(int(ends(assigned, heard, self.policy)[0] * 1000), now + 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        assigned, heard = self.lease.get() if self.lease.exists() else (None, None)
        before = assigned
        for ts, event in pd.concat(list(rows)).sort_values("ts", kind="stable")[["ts", "event"]].itertuples(index=False):
            t = ts.timestamp()
            if event in OPENING:
                assigned, heard = t, None
            elif event in CLOSING:
                assigned = None
            elif event == "heartbeat" and assigned is not None:
                heard = max(t, heard or t)
        if assigned is not None:
            self._armed(assigned, heard, timerValues.getCurrentProcessingTimeInMs())
        elif before is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.lease.clear()
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.lease.exists():
            return
        at, why = ends(*self.lease.get(), self.policy)
        self.lease.clear()
        yield pd.DataFrame({"assignment": [key[0]], "expired_at": [at], "reason": [why]})

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self._armed(float(row["assigned"]), None if pd.isna(row["heard"]) else float(row["heard"]), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stored(spark: SparkSession) -> None:
    """Sets the session's state store to the one that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def silent_expiries(log: DataFrame, p: SamplingPolicy | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """Rows (assignment, expired_at, reason) of a streaming log (assignment, ts timestamp, event), each as soon as the clock passes the end.

    snapshot: (assignment, assigned, heard) of leases open before the log begins, in seconds. Events do what they do in
    streaming/leases.py; of equal times the row that comes first counts first.
    """
    begin = snapshot.select("assignment", "assigned", "heard").groupBy("assignment") if snapshot is not None else None
    return log.groupBy("assignment").transformWithStateInPandas(Leases(p or SamplingPolicy()), OUT, "Append", "processingTime", begin)
