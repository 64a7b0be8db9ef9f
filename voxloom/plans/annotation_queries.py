"""The annotation queue on the driver tables: orders stand for cases, events for an annotator's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import policy, tables
from voxloom.functions.splits import hash_position
from voxloom.operators import queue
from voxloom.operators.ranks import placed
from voxloom.plans.base import query
from voxloom.session import table

APPROVED, REJECTED = "event_type = 'purchase'", "event_type = 'error'"
RECORD = """last AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id),
record AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS approved, count(*) FILTER (event_type = 'error') AS rejected,
count(*) FILTER (event_type = 'purchase' AND (bad IS NULL OR event_id > bad)) AS clean_streak,
count(*) FILTER (event_type IN ('purchase', 'view') AND (bad IS NULL OR event_id > bad)) AS since_rejection
FROM events JOIN last USING (user_id) GROUP BY user_id)"""
RATE = """CASE WHEN approved + rejected < 5 THEN 1.0 WHEN rejected > 0 AND since_rejection < 3 THEN 1.0 WHEN clean_streak >= 20 THEN 0.1 ELSE 0.2 END"""
ROLL = "(('0x' || substr(sha256('12345:' || event_id::varchar), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return queue.annotator_record(work, "user_id", ["event_id"], F.expr(APPROVED), F.expr(REJECTED), F.col("event_type").isin("purchase", "view"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS form, source, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def label_form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return found.groupBy(F.when(F.col("l").isNull(), "unlabelled").otherwise("labelled").alias("form"), "source").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (quality = 1) AS with_region, count(*) FILTER (quality IS DISTINCT FROM 1) AS without_region,
count(*) FILTER (toxic = 1) AS with_seed, count(*) FILTER (n_chars > 10000) AS with_gold FROM documents LEFT JOIN labels USING (doc_id)""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("with_region"),
        F.count_if(~good).alias("without_region"),
        F.count_if(F.col("toxic") == 1).alias("with_seed"),
        F.count_if(F.col("n_chars") > 10000).alias("with_gold"),
    )


@query("""SELECT o_orderkey, l_returnflag, l_partkey FROM (SELECT l_orderkey AS o_orderkey, l_returnflag, l_partkey,
row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey) AS r FROM lineitem WHERE l_returnflag IN ('R', 'A', 'N')) WHERE r = 1""")
def first_preference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_partkey")
    return queue.first_preference(items, ["o_orderkey"], "l_returnflag", ["R", "A", "N"], "l_partkey")


STATUS_SQL = "CASE WHEN o_totalprice < 5000 THEN 'retired' WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'pending' END"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_orderdate", "o_custkey",
        F.lit(1).alias("wanted"), (F.col("o_orderstatus") == "P").cast("int").alias("active"),
        (F.col("o_orderstatus") == "F").cast("int").alias("approved"), (F.col("o_totalprice") < 5000).alias("retired"),
    )


def _counts() -> list:
    return [F.col(c) for c in ("wanted", "active", "approved", "retired")]


@query(f"SELECT status, coalesce(n, 0) AS n FROM (VALUES ('pending'), ('in_progress'), ('complete'), ('retired')) s(status) LEFT JOIN (SELECT {STATUS_SQL} AS status, count(*) AS n FROM orders GROUP BY 1) USING (status)")
def case_burndown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.burn_down(_cases(spark, sf_dir), policy.case_status(*_counts()))


@query(f"""WITH c AS (SELECT {STATUS_SQL} AS status, o_orderdate FROM orders), s AS (SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS done,
count(*) FILTER (status = 'retired') AS retired, count(*) FILTER (status = 'complete' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY) / 14.0 AS v FROM c)
SELECT total, round(done / total, 6) AS complete_fraction, round(v, 2) AS approvals_per_day, greatest(0, total - done - retired) AS remaining,
CASE WHEN v > 0 THEN round(greatest(0, total - done - retired) / v, 1) END AS days_remaining FROM s""")
def trailing_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project statistics with the approvals of the last 14 days (AG-6, SM-9)."""
    cases = _cases(spark, sf_dir).withColumn("status", policy.case_status(*_counts()))
    now = cases.agg(F.max("o_orderdate").alias("now"))
    recent = (F.col("status") == "complete") & (F.col("o_orderdate") >= F.expr("now - INTERVAL 14 DAYS"))
    s = cases.join(F.broadcast(now)).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "complete").alias("done"),
        F.count_if(F.col("status") == "retired").alias("retired"),
        (F.count_if(recent) / 14.0).alias("v"),
    )
    remaining = F.greatest(F.lit(0), F.col("total") - F.col("done") - F.col("retired"))
    return s.select(
        "total",
        F.round(F.col("done") / F.col("total"), 6).alias("complete_fraction"),
        F.round("v", 2).alias("approvals_per_day"),
        remaining.alias("remaining"),
        F.when(F.col("v") > 0, F.round(remaining / F.col("v"), 1)).alias("days_remaining"),
    )


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS approved, count(*) FILTER (event_type = 'error') AS rejected,
round(coalesce(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('error', 'purchase')), 0), 0), 6) AS rejection_rate,
count(*) FILTER (event_type IN ('signup', 'view')) AS open, round(quantile_cont(value, 0.5) FILTER (value <> 0), 6) AS median_seconds, min(value) FILTER (value <> 0) AS fastest_seconds,
round(avg(value) FILTER (event_type = 'click'), 6) AS mean_agreement, count(value) FILTER (event_type = 'click') AS n_scored FROM events GROUP BY user_id""")
def annotator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("user_id", "event_type", "value")
    spent, score = F.when(F.col("value") != 0, F.col("value")), F.when(F.col("event_type") == "click", F.col("value"))
    rate = F.coalesce(F.try_divide(F.count_if(F.expr(REJECTED)), F.count_if(F.expr(f"{APPROVED} OR {REJECTED}"))), F.lit(0.0))
    return events.groupBy("user_id").agg(
        F.count_if(F.expr(APPROVED)).alias("approved"),
        F.count_if(F.expr(REJECTED)).alias("rejected"),
        F.round(rate, 6).alias("rejection_rate"),
        F.count_if(F.col("event_type").isin("signup", "view")).alias("open"),
        F.round(F.median(spent), 6).alias("median_seconds"),
        F.min(spent).alias("fastest_seconds"),
        F.round(F.avg(score), 6).alias("mean_agreement"),
        F.count(score).alias("n_scored"),
    )


@query("""SELECT n_name, count(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS building, count(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS machinery
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def reviewer_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by two values, zero-filled (AG-9)."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    nations = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("c_nationkey"))
    return nations.join(customers, "c_nationkey", "left").na.fill(0).select("n_name", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"))


@query(f"WITH {RECORD} SELECT * FROM record")
def clean_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(spark, sf_dir)


@query(f"WITH {RECORD} SELECT user_id, CAST({RATE} AS DOUBLE) AS rate FROM record")
def review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = policy.review_rate(*[F.col(c) for c in ("approved", "rejected", "clean_streak", "since_rejection")])
    return _record(spark, sf_dir).select("user_id", rate.alias("rate"))


@query(f"""WITH {RECORD} SELECT event_id, ({ROLL} < CASE WHEN event_type = 'purchase' THEN {RATE} ELSE 0.2 END) OR (event_type = 'click' AND value < 10) AS needed
FROM events JOIN record USING (user_id)""")
def review_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which work a reviewer sees; clicks are gold cases whose score is value / 100 + 0.6 (FN-6)."""
    rate = policy.review_rate(*[F.col(c) for c in ("approved", "rejected", "clean_streak", "since_rejection")])
    work = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "value").join(_record(spark, sf_dir), "user_id")
    kind = F.when(F.col("event_type") == "click", policy.GOLD).otherwise(policy.NORMAL)
    score = F.when(F.col("value") < 10, 0.5).otherwise(0.9)
    applied = F.when(F.expr(APPROVED), rate).otherwise(0.2)
    return work.select("event_id", policy.review_needed(hash_position(F.col("event_id")), applied, kind, score).alias("needed"))


@query(f"""SELECT event_id, CASE WHEN event_id % 50 = 0 AND gold THEN 'gold' WHEN gold AND roll < 0.05 THEN 'gold' WHEN roll < 0.1 THEN 'duplicate' ELSE 'normal' END AS kind
FROM (SELECT event_id, {ROLL} AS roll, event_type <> 'error' AS gold FROM events)""")
def injection_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "event_type")
    kind = policy.injection_kind(hash_position(F.col("event_id")), F.col("event_id") % 50, F.col("event_type") != "error", F.lit(True))
    return events.select("event_id", kind.alias("kind"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    return queue.latest(events, ["user_id", "event_type"], ["event_id"])


@query("""SELECT a.o_orderkey, (SELECT min_by(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority <> a.o_orderpriority) AS partner FROM orders a""")
def duplicate_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for cases, priorities for annotators (JN-8)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return queue.duplicate_partner(orders, "o_custkey", "o_orderpriority", "o_orderkey", ["o_orderdate"])


@query("""SELECT o_orderkey, r::INTEGER AS replica, 'case' || o_custkey || CASE WHEN r > 1 THEN '__r' || r ELSE '' END AS replica_name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def replica_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    name = F.concat(F.lit("case"), F.col("o_custkey"))
    return queue.replica_names(orders, "o_custkey", name, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "replica", "replica_name")


@query("""WITH u AS (SELECT user_id, epoch(min(ts))::DOUBLE AS a, epoch(max(ts) FILTER (event_type = 'view'))::DOUBLE AS h FROM events GROUP BY user_id),
n AS (SELECT (SELECT epoch(min(ts)) FROM events) + 8 * 86400.0 AS now)
SELECT user_id, CASE WHEN now >= a + 604800 THEN 'lease of 7 days expired' ELSE 'no heartbeat for 72 hours' END AS reason FROM u, n
WHERE now >= a + 604800 OR now - h >= 259200""")
def lease_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments that a sweep on the ninth day would expire, each once, with the reason (FN-9, ST-7, MU-8)."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    seconds = _events(spark, sf_dir).select("user_id", "event_type", F.floor(at).cast("double").alias("s"), at.alias("x"))
    users = seconds.groupBy("user_id").agg(F.min("x").alias("a"), F.max(F.when(F.col("event_type") == "view", F.col("x"))).alias("h"))
    now = seconds.agg((F.min("x") + 8 * 86400.0).alias("now"))
    swept = users.join(F.broadcast(now)).select("user_id", policy.reclaim_reason(F.col("a"), F.col("h"), F.col("now")).alias("reason"))
    return swept.where("reason IS NOT NULL")


@query("""SELECT o_orderkey, c_name, o_orderdate::VARCHAR AS submitted, coalesce(n_items, 0) AS n_items FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN
(SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 10""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest work under review, a page of 50; only the page's rows are joined (PF-8, JN-6, SO-5)."""
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    page = waiting.orderBy("o_orderdate", "o_orderkey").offset(10).limit(50)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(F.broadcast(page.select("o_orderkey")), "o_orderkey", "left_semi")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = page.join(items.groupBy("o_orderkey").agg(F.count("*").alias("n_items")), "o_orderkey", "left").na.fill(0).join(people, "o_custkey")
    return found.select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("submitted"), "n_items")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY 1 LIMIT 25)")
def semijoin_patient_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = orders.select("o_custkey").distinct().orderBy("o_custkey").limit(25)
    return orders.join(F.broadcast(first), "o_custkey", "left_semi")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT kind, count(*) AS n, count(DISTINCT o_custkey) AS patients, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM
(SELECT 'label' AS kind, * FROM l UNION ALL SELECT 'image', o_orderkey, o_custkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT o_orderkey FROM l)) GROUP BY kind""")
def cte_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and their images as one list, summarised (JN-12, ST-6, AG-15, AG-16)."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    known = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items.where("l_returnflag = 'R'"), "o_orderkey", "left_semi")
    # a label is an image's row too; customers and flags are counted before they are listed, so that no task sorts all rows of a kind
    pairs = items.join(known, "o_orderkey").groupBy("o_custkey", "l_returnflag").agg(F.count("*").alias("n"))
    kinds = F.when(F.col("l_returnflag") == "R", F.array(F.lit("label"), F.lit("image"))).otherwise(F.array(F.lit("image")))
    both = pairs.select(F.explode(kinds).alias("kind"), "*")
    patients = both.groupBy("kind", "o_custkey").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("o_custkey").alias("patients"))
    flags = both.select("kind", "l_returnflag").distinct().groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "|").alias("flags"))
    return patients.join(F.broadcast(flags), "kind").select("kind", "n", "patients", "flags")


@query("""SELECT o_orderkey FROM orders o WHERE o_totalprice >= 5000 AND o_orderstatus = 'O' AND NOT EXISTS
(SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_suppkey = 7) ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 32""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cases that can be served to an annotator (supplier 7) who has not had them (PF-3, PF-4, JN-20, SO-4)."""
    cases = _cases(spark, sf_dir).where(policy.servable(*_counts())).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    mine = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return cases.join(mine, "o_orderkey", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(32).select("o_orderkey")


@query("SELECT count(*) AS n, count(*) > 0 AS available FROM orders WHERE o_totalprice >= 5000 AND o_orderstatus = 'F'")
def duplicate_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases a second annotator could take (PF-5, PF-6)."""
    found = _cases(spark, sf_dir).where(policy.duplicatable(*_counts()))
    return found.agg(F.count("*").alias("n")).withColumn("available", F.col("n") > 0)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN greatest(0, c_custkey % 20 - n) END AS quota_left,
(c_custkey % 3 = 0 OR greatest(0, c_custkey % 20 - n) > 0) AND open < 1 AS more FROM (SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n,
count(o_orderkey) FILTER (o_orderstatus = 'P') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def quota_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaining quota, null without one, and whether more work may be taken (AG-17, FN-8)."""
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("open")
    )
    users = table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left").na.fill(0, ["n", "open"])
    quota = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 20)
    users = users.withColumn("quota_left", policy.quota_remaining(quota, F.col("n")))
    return users.select("c_custkey", "quota_left", policy.can_take_more(F.col("open"), F.col("quota_left")).alias("more"))


@query("""SELECT state, event, next_state, next_state IS NOT NULL AS legal FROM
(SELECT unnest(['assigned', 'downloaded', 'submitted', 'under_review', 'approved', 'rejected', 'released']) AS state) s CROSS JOIN
(SELECT unnest(['download', 'submit', 'approve', 'reject']) AS event) e LEFT JOIN
(VALUES ('assigned', 'download', 'downloaded'), ('downloaded', 'submit', 'submitted'), ('submitted', 'approve', 'approved'), ('submitted', 'reject', 'rejected'),
('under_review', 'approve', 'approved'), ('under_review', 'reject', 'rejected')) t(state, event, next_state) USING (state, event)""")
def transition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state with four events: next state, or illegal (JN-16)."""
    states = ["assigned", "downloaded", "submitted", "under_review", "approved", "rejected", "released"]
    pairs = [(s, e) for s in states for e in ("download", "submit", "approve", "reject")]
    return queue.with_next_state(spark.createDataFrame(pairs, "state string, event string")).select("state", "event", "next_state", "legal")


# an assignment as one number: ((refused * 10000 + applied) * 10000 + attempt) * 8 + state
_LEGAL = {("signup", 0): 1, ("view", 1): 2, ("purchase", 2): 4, ("click", 2): 5, ("error", 5): 0}
_CODE = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END::BIGINT"
_EVENTS = ["signup", "view", "click", "error", "purchase"]
_STEPS = " ".join(f"WHEN e = {_EVENTS.index(e)} AND s % 8 = {a} THEN s + {b - a + 80_000 + 8 * (e == 'error')}" for (e, a), b in _LEGAL.items())


@query(f"""SELECT user_id, ['assigned', 'downloaded', 'submitted', 'under_review', 'approved', 'rejected', 'released'][x % 8 + 1] AS state, ((x // 8) % 10000)::INTEGER AS attempt,
((x // 80000) % 10000)::INTEGER AS n_applied, (x // 800000000)::INTEGER AS n_refused FROM
(SELECT user_id, list_reduce(list_prepend(8::BIGINT, list({_CODE} ORDER BY event_id)), lambda s, e: CASE {_STEPS} ELSE s + 800000000 END) AS x FROM events GROUP BY user_id)""")
def transition_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment states from a transition log, illegal events refused (MU-5, WN-12)."""
    names = {"signup": "download", "view": "submit", "click": "reject", "error": "rework", "purchase": "approve"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    log = _events(spark, sf_dir).select("user_id", "event_id", event.alias("event"))
    return queue.folded_log(log, "user_id", "event", ["event_id"])


@query()
def claim_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask for work in the order of their keys; open orders have one slot each (MU-1, MU-2)."""
    requests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user"), F.col("s_suppkey").alias("arrived"))
    cases = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("case"), F.floor("o_totalprice").alias("priority"), F.col("o_orderdate").alias("created"), F.lit(1).alias("slots")
    )
    taken = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_orderkey").alias("case"))
    return queue.allocate(requests, cases, taken)


@query("""SELECT l_orderkey, l_partkey FROM lineitem l WHERE l_shipdate < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey AND p_size > 10)""")
def sweep_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads older than a day that neither of two ways shows in flight (MU-9, JN-19)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    old = items.join(F.broadcast(items.agg(F.max("l_shipdate").alias("now")))).where("l_shipdate < now - INTERVAL 1 DAY")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return old.join(orders, "l_orderkey", "left_anti").join(parts, "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


CHECKS = """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN r = 0 THEN 'empty_required_segment:R' WHEN r <= 8 THEN 'stray_voxels:R' END,
CASE WHEN a BETWEEN 1 AND 8 THEN 'stray_voxels:A' END, CASE WHEN n > 0 THEN 'unexpected_segment:N' END, CASE WHEN a = 0 THEN 'empty_optional_segment:A' END,
CASE WHEN s < 60 THEN 'implausibly_fast:' || round(s)::BIGINT END], lambda x: x IS NOT NULL), ',') AS problems FROM c"""


@query(CHECKS)
def submission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the line items of an order: R required, A optional, N unexpected; quantity stands for seconds (FN-10, SO-6)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    orders = items.groupBy("l_orderkey").agg(F.create_map(*[x for f in "RAN" for x in (F.lit(f), n(f))]).alias("counts"), F.sum("l_quantity").alias("seconds"))
    problems = policy.check_submission(F.col("counts"), ["R"], ["A"], F.col("seconds"))
    return orders.select("l_orderkey", F.array_join(F.transform(problems, lambda p: F.concat_ws(":", p["code"], p["subject"])), ",").alias("problems"))


@query(CHECKS)
def submission_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules as a table function over a table of submissions (UD-6)."""
    tables.register(spark)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("segment"), "l_quantity")
    # dealt by order once, for the segments and for the lists of them
    counts = items.repartition("key").groupBy("key", "segment").agg(F.count("*").alias("voxels"), F.sum("l_quantity").alias("seconds"))
    rows = counts.groupBy("key").agg(F.collect_list(F.struct("segment", "voxels")).alias("s"), F.sum("seconds").alias("seconds"))
    rows = rows.select("key", F.col("s.segment").alias("segments"), F.col("s.voxels").alias("voxels"), "seconds")
    found = spark.sql("SELECT * FROM submission_problems(TABLE(SELECT * FROM {rows}), 'R', 'A')", rows=rows)
    level = F.when(F.col("level") == "error", 0).otherwise(1)
    # The order of the rules.
    rule = F.array_position(F.array(*[F.lit(c) for c in ("R", "A", "N")]), F.col("subject"))
    said = F.struct(level.alias("l"), F.when(rule == 0, 9).otherwise(rule).alias("r"), F.concat_ws(":", "code", "subject").alias("s"))
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), said))).alias("p"))
    return listed.select(F.col("key").alias("l_orderkey"), F.array_join(F.transform("p", lambda p: p["s"]), ",").alias("problems"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type IN ('click', 'error') AND value / 100 < 0.7 THEN 'mean Dice ' || round((value / 100)::DECIMAL(18, 6), 2)::DECIMAL(18, 2) || CASE event_type WHEN 'click' THEN ' against the reference' ELSE ' against the other annotator' END END,
CASE WHEN value > 0 AND value < 60 THEN 'only ' || round(value::DECIMAL(18, 6), 0)::DECIMAL(18, 0) || ' s spent on the case' END, CASE WHEN event_id % 3 = 0 THEN 'stray:' || event_type END], lambda x: x IS NOT NULL), ';') AS reasons FROM events""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to look at a submission: scores of gold and duplicate work, haste, warnings (FN-12)."""
    v, t = F.col("value"), F.col("event_type")
    kind = F.when(t == "click", policy.GOLD).when(t == "error", policy.DUPLICATE).otherwise(policy.NORMAL)
    dice = F.when(t.isin("click", "error"), v / 100)
    warnings = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("stray:"), t)))
    flags = policy.review_flags(kind, dice, v, warnings)
    return _events(spark, sf_dir).select("event_id", F.array_join(flags, ";").alias("reasons"))


@query("""SELECT user_id, approved, (row_number() OVER (ORDER BY approved DESC, user_id) - 1)::BIGINT AS place FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS approved FROM events GROUP BY 1)""")
def annotators_by_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators from the most approved work on, ties by name (SO-11)."""
    per = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.expr(APPROVED)).alias("approved"))
    return placed(per, [F.desc("approved"), F.col("user_id")])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'O' OR o_totalprice < 5000 THEN 'not_servable' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey) THEN 'had_it' ELSE 'assigned' END AS outcome FROM orders""")
def assigned_to_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases (orders) given to users that an administrator names (customers), where they may have them (MU-10)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_custkey").alias("user"))
    cases = _cases(spark, sf_dir).select(F.col("o_orderkey").alias("case"), *[c.alias(n) for c, n in zip(_counts(), ("wanted", "active", "approved", "retired"), strict=True)])
    met = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_orderkey").alias("case"))
    return queue.assigned(orders, cases, met).select(F.col("case").alias("o_orderkey"), F.col("user").alias("o_custkey"), "outcome")
