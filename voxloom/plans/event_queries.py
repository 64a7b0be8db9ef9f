"""Training logs: a user's events stand for one run's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import runs
from voxloom.plans.base import query
from voxloom.session import table

KINDS = {"signup": "run_start", "view": "epoch", "click": "preview", "error": "log", "purchase": "run_end"}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, pos, t, event, epoch, status, value) from the events table."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        kind[F.col("event_type")].alias("event"),
        F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("bigint")).alias("epoch"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), "paused").alias("status"),
        "value",
    )


RUN_STATE_SQL = """SELECT user_id AS run, round(max_by(epoch(ts), event_id) FILTER (event_type = 'signup'), 3) AS started_at,
coalesce(max(event_id) FILTER (event_type = 'purchase') > coalesce(max(event_id) FILTER (event_type = 'signup'), -1), false) AS finished,
CASE WHEN max(event_id) FILTER (event_type = 'purchase') > coalesce(max(event_id) FILTER (event_type = 'signup'), -1) THEN max_by(CASE WHEN value > 50 THEN 'paused' ELSE 'completed' END, event_id) FILTER (event_type = 'purchase')
WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'running' ELSE 'unknown' END AS status,
count(*) FILTER (event_type = 'view') AS n_epochs, 0::BIGINT AS n_checkpoints, count(*) FILTER (event_type = 'click') AS n_previews, count(*) FILTER (event_type = 'error') AS n_messages,
round(max_by(epoch(ts), event_id), 3) AS last_event_time, max_by(json_extract_string(props, '$.k')::BIGINT, event_id) FILTER (event_type = 'view') AS current_epoch FROM events GROUP BY user_id"""


@query(RUN_STATE_SQL)
def run_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.run_states(run_log(spark, sf_dir))
    return found.withColumn("started_at", F.round("started_at", 3)).withColumn("last_event_time", F.round("last_event_time", 3))


@query(RUN_STATE_SQL)
def stream_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream of the table's files (SM-1, SM-3, SM-4)."""
    from voxloom.streaming.fold import streamed_states

    return streamed_states(spark, f"{sf_dir}/events.parquet")


@query("""WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'view')
SELECT user_id AS run, max(k) FILTER (r = 1) AS current, round(avg(value) FILTER (value <> 0), 6) AS mean_seconds, round((1000 - max(k) FILTER (r = 1) - 1) * avg(value) FILTER (value <> 0), 4) AS eta FROM v WHERE r <= 20 GROUP BY user_id""")
def eta_last20(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = run_log(spark, sf_dir).where("event = 'epoch'")
    found = runs.eta_seconds(epochs, "run", ["pos"], "epoch", "value", F.lit(1000))
    return found.select("run", "current", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("eta", 4).alias("eta"))


@query("SELECT vec_id, round(list_avg(list_filter(embedding, lambda x: x >= 0)::DOUBLE[]), 6) AS mean FROM embeddings")
def mean_array_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of an array's known values; negatives are nulled first (AG-18)."""
    known = F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(runs.mean_of_known(known), 6).alias("mean"))


@query("""SELECT run, k, place::INTEGER AS place FROM (SELECT user_id AS run, k, row_number() OVER (PARTITION BY user_id ORDER BY f) AS place FROM
(SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, min(event_id) AS f FROM events WHERE event_type = 'click' GROUP BY 1, 2)) """)
def preview_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct preview cases by first appearance (WN-9)."""
    log = table(spark, sf_dir, "events").where("event_type = 'click'")
    rows = log.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return runs.first_seen(rows, "run", "k", "pos").select("run", "k", "place")


@query("SELECT user_id AS run, max_by(value, event_id) AS latest, max(value) AS best FROM events WHERE event_type = 'click' GROUP BY 1")
def latest_and_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest and best score of a run (AG-19, WN-8)."""
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), "value")
    return runs.latest_and_best(rows, "run", "value", "pos")


@query("""SELECT event_id FROM (SELECT *, sum(value) OVER w AS s, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)) WHERE s > 500 AND r > 1""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest entries of a full cache (WN-10)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return runs.cache_keep(rows, "user_id", "value", ["event_id"], 500.0).where("evict").select("event_id")


@query("""SELECT user_id, event_id, round(sum(greatest(0, value - 40)) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS elapsed,
1 + count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events""")
def running_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and attempts so far (WN-12, WN-13)."""
    from pyspark.sql import Window as W

    so_far = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return rows.select(
        "user_id",
        "event_id",
        F.round(F.sum(F.greatest(F.lit(0.0), F.col("value") - 40)).over(so_far), 4).alias("elapsed"),
        (1 + F.count_if(F.col("event_type") == "error").over(so_far)).alias("attempt"),
    )


@query("""SELECT e.user_id, e.k AS epoch, d.value AS dice FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY 1, 2) e
LEFT JOIN (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) d ON d.user_id = e.user_id AND d.k = e.k""")
def epochs_with_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs and the last score of the same epoch, null where none (JN-15)."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("epoch"))
    epochs = events.where("event_type = 'view'").select("user_id", "epoch").distinct()
    scores = events.where("event_type = 'click'").groupBy("user_id", "epoch").agg(F.max_by("value", "event_id").alias("dice"))
    return epochs.join(scores, ["user_id", "epoch"], "left")


@query("""SELECT user_id, event_id, value > 90 OR coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id, json_extract_string(props, '$.k')), false) AS needs_review FROM events WHERE event_type IN ('view', 'error')""")
def late_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that arrives later may raise the review flag, never lower it (MU-7, SM-8)."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'error')").withColumn("k", F.get_json_object("props", "$.k"))
    raised = rows.groupBy("user_id", "k").agg(F.bool_or(F.col("event_type") == "error").alias("raised"))
    return rows.join(raised, ["user_id", "k"]).select("user_id", "event_id", ((F.col("value") > 90) | F.col("raised")).alias("needs_review"))


@query("""WITH l AS (SELECT user_id, event_id, floor(value / 34)::BIGINT AS size, event_type, lag(floor(value / 34)::BIGINT) OVER w AS before, lag(event_type) OVER w AS type_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_type AS version, min(event_id) AS event_id FROM l WHERE size = before AND event_type = type_before GROUP BY 1, 2""")
def settled_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each version of a file was first seen whole (SM-5): users stand for files, events for looks at them."""
    looks = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 34).alias("size"), F.col("event_type").alias("version"))
    return runs.settled_files(looks, "user_id", ["event_id"], "size", "version")
