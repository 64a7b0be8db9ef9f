"""Claims that arrive while others work: a stream of requests served in micro-batches from a versioned state.

The state is a table of cases and a log of claims that every batch appends to; a case's counters are its own and those
of its claims. A batch and the claims it makes are committed together, so a batch that is run again after a restart
serves nobody twice, and two streams on one state never give a slot away twice: the slower one starts its batch again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.functions.policy import DUPLICATE, GOLD, NORMAL, SamplingPolicy, can_take_more, duplicatable, injection_kind, servable
from voxloom.operators.queue import allocate
from voxloom.session import kept
from voxloom.sources.snapshots import Snapshots, Version

CASES = "case bigint, priority bigint, created bigint, gold boolean, wanted int, active int, approved int, retired boolean"
CLAIMS = "request bigint, user bigint, case bigint, kind string, batch bigint"


CLOSINGS = "user bigint, case bigint, event string"


def current_cases(cases: DataFrame, claims: DataFrame, closings: DataFrame) -> DataFrame:
    """cases with what became of their slots: a claim takes one, a duplicate's also asks for the second replica; release and complete give one back, complete approves."""
    took = claims.select("case", F.lit(1).alias("_a"), F.lit(0).alias("_d"), (F.col("kind") == DUPLICATE).alias("_w"))
    back = closings.select("case", F.lit(-1).alias("_a"), F.when(F.col("event") == "complete", 1).otherwise(0).alias("_d"), F.lit(False).alias("_w"))
    moved = took.unionByName(back).groupBy("case").agg(F.sum("_a").cast("int").alias("_a"), F.sum("_d").cast("int").alias("_d"), F.max("_w").alias("_w"))
    found = cases.join(moved, "case", "left")
    return found.select(
        "case", "priority", "created", "gold", F.when(F.col("_w"), 2).otherwise(F.col("wanted")).alias("wanted"),
        F.greatest(F.col("active") + F.coalesce("_a", F.lit(0)), F.lit(0)).alias("active"), (F.col("approved") + F.coalesce("_d", F.lit(0))).alias("approved"), "retired",
    )


def open_work(claims: DataFrame, closings: DataFrame) -> DataFrame:
    """(user, more): claims of each user that nothing closed."""
    rows = claims.select("user", F.lit(1).alias("n")).unionByName(closings.select("user", F.lit(-1).alias("n")))
    return rows.groupBy("user").agg(F.greatest(F.sum("n"), F.lit(0)).alias("more"))


def served(requests: DataFrame, cases: DataFrame, met: DataFrame, p: SamplingPolicy | None = None) -> DataFrame:
    """(request, user, outcome, case, kind) of a batch of requests (request, user, arrived, roll, submitted, open, quota_left).

    cases: CASES as they are now; met: (user, case) pairs that must not meet again. Of a user's
    requests in a batch the first, by (arrived, request), counts and the rest are at_limit, as is a user with too much open
    work; quota_left below 1 is `quota`. The roll picks gold, duplicate or normal among the pools that
    have something for the user; who finds nothing left in a pool falls back to a normal case, else the queue is empty.
    """
    p = p or SamplingPolicy()
    met = kept(met.select("user", "case").distinct())
    counts = [F.col(c) for c in ("wanted", "active", "approved", "retired")]
    pools = {GOLD: servable(*counts) & F.col("gold"), DUPLICATE: duplicatable(*counts), NORMAL: servable(*counts) & ~F.col("gold")}
    live = kept(cases)

    def some_left(pool: Column) -> tuple[int, DataFrame]:
        """How many cases a pool has, and how many of them each user had."""
        mine = live.where(pool).select("case")
        return mine.count(), met.join(mine, "case", "left_semi").groupBy("user").agg(F.count("*").alias("_had"))

    first = requests.groupBy("user").agg(F.min(F.struct("arrived", "request")).alias("_first"))
    asked = requests.join(first, "user").withColumn("_one", F.struct("arrived", "request") == F.col("_first")).drop("_first")
    for kind in (GOLD, DUPLICATE):
        n, had = some_left(pools[kind])
        asked = asked.join(had, "user", "left").withColumn(f"_{kind}", F.lit(n) > F.coalesce("_had", F.lit(0))).drop("_had")
    spent = F.coalesce(F.col("quota_left") < 1, F.lit(False))
    may = F.col("_one") & can_take_more(F.col("open"), F.col("quota_left"), p)
    kind = injection_kind(F.col("roll"), F.col("submitted"), F.col(f"_{GOLD}"), F.col(f"_{DUPLICATE}"), p)
    asked = kept(asked.withColumn("_refused", F.when(spent, "quota").when(~may, "at_limit")).withColumn("kind", kind))
    waiting = asked.where("_refused IS NULL").select("user", "arrived", "kind")
    won = None
    for name in (GOLD, DUPLICATE, NORMAL):  # normal last: it also takes those whose pool ran dry
        pool = live.where(pools[name]).select("case", "priority", "created", (F.lit(1) if name == DUPLICATE else F.col("wanted") - F.col("active") - F.col("approved")).alias("slots"))
        queue = waiting.where(F.col("kind") == name) if name != NORMAL else waiting
        new = kept(allocate(queue, pool, met).withColumn("kind", F.lit(name)))
        won = new if won is None else won.unionByName(new)
        waiting = kept(waiting.join(new.select("user"), "user", "left_anti"))
    given = asked.drop("kind").join(won, "user", "left").withColumn("case", F.when(F.col("_refused").isNull() & F.col("_one"), F.col("case")))
    outcome = F.coalesce("_refused", F.when(F.col("case").isNotNull(), "served").otherwise("queue_empty"))
    return given.select("request", "user", outcome.alias("outcome"), "case", F.when(F.col("case").isNotNull(), F.col("kind")).alias("kind"))


class LiveClaims:
    """Serves a stream of requests from the cases that `state` was opened with."""

    def __init__(self, state: Snapshots, source: str = "claims", policy: SamplingPolicy | None = None):
        self.state, self.source, self.policy = state, source, policy

    @staticmethod
    def opened(spark: SparkSession, path: str, cases: DataFrame, past: DataFrame | None = None) -> Snapshots:
        """A state of cases (CASES) and (user, case) pairs from before; one that exists already is left as it is."""
        state = Snapshots(spark, path)
        if not state.version().number:
            none = spark.createDataFrame([], "user bigint, case bigint")
            state.commit({"cases": cases, "past": past if past is not None else none, "claims": spark.createDataFrame([], CLAIMS), "closings": spark.createDataFrame([], CLOSINGS)}, Version(0))
        return state

    def batch(self, requests: DataFrame, number: int) -> None:
        """Serves one batch; outcomes of the batch go to outcomes/<source>/b=<number>, where a batch that is run again before its commit replaces itself."""
        requests = kept(requests)

        def change(now: Version) -> tuple[dict, dict]:
            cases, past, claims, closings = (self.state.read(t, now) for t in ("cases", "past", "claims", "closings"))
            asked = requests.join(open_work(claims, closings), "user", "left").withColumn("open", F.col("open") + F.coalesce("more", F.lit(0))).drop("more")
            out = kept(served(asked, current_cases(cases, claims, closings), past.unionByName(claims.select("user", "case")), self.policy))
            out.write.mode("overwrite").parquet(f"{self.state.path}/outcomes/{self.source}/b={number}")
            new = out.where("outcome = 'served'").select("request", "user", "case", "kind", F.lit(number).cast("bigint").alias("batch"))
            return {}, {"claims": new}

        self.state.update(change, self.source, number)
        self.state.compacted("claims")

    def closed(self, rows: DataFrame, number: int) -> None:
        """Appends closings (user, case, event) of a batch; a number that was there already changes nothing."""
        self.state.update(lambda now: ({}, {"closings": rows.select("user", "case", "event")}), f"{self.source}-closings", number)

    def start(self, requests: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The running query over a stream of requests; trigger as DataStreamWriter takes it, e.g. processingTime='10 seconds'."""
        writer = requests.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
