"""Run states from a stream: each micro-batch is reduced to a few rows a run and merged with the state so far."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.session import shared_dir

STATE = "started_at double, start_pos bigint, end_pos bigint, status string, n_epochs bigint, n_checkpoints bigint, n_previews bigint, n_messages bigint, last_t double, last_pos bigint, epoch bigint, epoch_pos bigint"
OUT = "run bigint, started_at double, finished boolean, status string, n_epochs bigint, n_checkpoints bigint, n_previews bigint, n_messages bigint, last_event_time double, current_epoch bigint"
COUNTED = {"epoch": 4, "checkpoint": 5, "preview": 6, "log": 7}


def fold(key: tuple, batches, state: GroupState):
    """Applies a run's new rows in log order; rows older than what was seen count, but do not overrule it."""
    s = list(state.get) if state.exists else [None, -1, -1, None, 0, 0, 0, 0, None, -1, None, -1]
    for rows in batches:
        for pos, t, event, epoch, status in rows.sort_values("pos")[["pos", "t", "event", "epoch", "status"]].itertuples(index=False):
            if t == t and pos > s[9]:
                s[8], s[9] = t, pos
            if event == "run_start" and pos > s[1]:
                s[0], s[1] = t, pos
            elif event == "run_end" and pos > s[2]:
                s[2], s[3] = pos, status if isinstance(status, str) else "completed"
            elif event in COUNTED:
                s[COUNTED[event]] += 1
                if event == "epoch" and pos > s[11]:
                    s[10], s[11] = (None if epoch != epoch or epoch is None else int(epoch)), pos
    state.update(tuple(s))
    over = s[2] > s[1]
    status = s[3] if over else "running" if s[1] >= 0 else "unknown"
    row = (key[0], s[0], over, status, *s[4:8], s[8], s[10])
    yield pd.DataFrame([row], columns=[f.split(" ")[0] for f in OUT.split(", ")]).astype({"current_epoch": "Int64"})


def folded_stream(log: DataFrame) -> DataFrame:
    """A streaming log (run, pos, t, event, epoch, status) as updates of run states."""
    return log.groupBy("run").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def streamed_states(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """Reads a directory or file of events as a stream until it is used up; the last state of each run.

    Updates go to files through foreachBatch, with the batch's number, so a repeated batch replaces itself.
    """
    from voxloom.plans.event_queries import KINDS

    base = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") else f"{folder}/{name}*")
    log = events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        kind[F.col("event_type")].alias("event"),
        F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("bigint")).alias("epoch"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), "paused").alias("status"),
    )

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/b={batch}")

    folded_stream(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    rest = [c for c in out.columns if c not in ("run", "b", "batch")]
    last = out.groupBy("run").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("run", "s.*")
    return last.withColumn("started_at", F.round("started_at", 3)).withColumn("last_event_time", F.round("last_event_time", 3))
