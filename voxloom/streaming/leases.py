"""Leases that run out in a stream: an assignment without news for too long, or too old, is reported once.

Timers follow event time: a lease runs out when the watermark, which the events of all assignments
move, has passed its end; nothing is polled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.functions.policy import SamplingPolicy

STATE = "assigned double, heard double"
OUT = "assignment bigint, expired_at double, reason string"
OPENING, CLOSING = ("assign", "rework"), ("submit", "release", "approve", "expire")


def ends(assigned: float, heard: float | None, p: SamplingPolicy) -> tuple[float, str]:
    """When a lease ends at the latest, and why; a missing heartbeat alone ends none."""
    lease = (assigned + p.lease_days * 86400, f"lease of {p.lease_days:.3g} days expired")
    if heard is None:
        return lease
    return min(lease, (heard + p.stale_heartbeat_hours * 3600, f"no heartbeat for {p.stale_heartbeat_hours:.3g} hours"))


def expiries(log: DataFrame, p: SamplingPolicy | None = None, delay: str = "0 seconds") -> DataFrame:
    """Rows (assignment, expired_at, reason) of a streaming log (assignment, ts timestamp, event).

    assign and rework open a lease, heartbeats renew the silence it may last, closing events end it; events of
    assignments without a lease change nothing.
    """
    p = p or SamplingPolicy()

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            assigned, heard = state.get
            at, why = ends(assigned, heard, p)
            state.remove()
            yield pd.DataFrame({"assignment": [key[0]], "expired_at": [at], "reason": [why]})
            return
        assigned, heard = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, event in zip(rows["ts"], rows["event"], strict=True):
            t = ts.timestamp()
            if event in OPENING:
                assigned, heard = t, None
            elif event in CLOSING:
                assigned = None
            elif event == "heartbeat" and assigned is not None:
                heard = max(t, heard or t)
        if assigned is None:
            if state.exists:
                state.remove()
        else:
            state.update((assigned, heard))
            state.setTimeoutTimestamp(max(int(ends(assigned, heard, p)[0] * 1000), state.getCurrentWatermarkMs() + 1))

    timed = log.withWatermark("ts", delay)
    return timed.groupBy("assignment").applyInPandasWithState(watch, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
