"""Slots, submissions, verdicts and scores of the work queue, and reports over cases and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import policy, text
from voxloom.operators import queue, ranks, voxels
from voxloom.plans.base import query
from voxloom.plans.voxel_queries import SCORES, _balls
from voxloom.session import table

# a case's counters as one number: (((refused * B + wanted) * B + active) * B + approved) * 2 + retired
_B = 10_000
_W, _A, _P, _R = f"((s // {2 * _B * _B}) % {_B})", f"((s // {2 * _B}) % {_B})", f"((s // 2) % {_B})", "(s % 2)"
_BACK = f"CASE WHEN {_A} > 0 THEN s - {2 * _B} ELSE s END"
SLOTS_SQL = f"""SELECT user_id, {_W.replace('s //', 'x //')} AS wanted, {_A.replace('s //', 'x //')} AS active, {_P.replace('s //', 'x //')} AS approved, x % 2 = 1 AS retired, x // {2 * _B**3} AS refused FROM
(SELECT user_id, list_reduce(list_prepend({2 * _B * _B}::BIGINT, list(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END::BIGINT ORDER BY event_id)), lambda s, e: CASE
WHEN e = 0 AND {_R} = 0 AND {_A} + {_P} < {_W} THEN s + {2 * _B}
WHEN e = 3 AND {_R} = 0 AND {_W} = 1 AND {_P} = 1 AND {_A} = 0 THEN s + {2 * _B + 2 * _B * _B}
WHEN e IN (0, 3) THEN s + {2 * _B**3} WHEN e = 1 THEN {_BACK} WHEN e = 2 THEN {_BACK} + 2 ELSE s - {_R} + 1 END) AS x FROM events GROUP BY user_id)"""


@query(SLOTS_SQL)
def slot_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of cases (users) from their slot events, refused claims counted (MU-1 to MU-4)."""
    names = {"signup": "claim", "view": "release", "click": "complete", "error": "claim_duplicate", "purchase": "retire"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    log = table(spark, sf_dir, "events").select("user_id", "event_id", event.alias("event"))
    found = queue.slot_counters(log, "user_id", "event", ["event_id"])
    return found.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in ("wanted", "active", "approved")], "retired", F.col("refused").cast("bigint").alias("refused"))


@query()
def stamped_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment states with a time for each kind of step and the deadline of the attempt (MU-5); tested against a plain loop."""
    names = {"signup": "download", "view": "submit", "click": "reject", "error": "rework", "purchase": "approve"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return queue.stamped_log(table(spark, sf_dir, "events").select("user_id", "event_id", event.alias("event"), at.alias("at")), "user_id", "event", "at", ["event_id"])


@query("""WITH r AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_returnflag = 'R' AS reject, l_tax < 0.02 AS bare, o_orderstatus IN ('F', 'P') AS open FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT *, open AND NOT (reject AND bare) AS fit FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, fit ORDER BY l_shipdate, l_linenumber) AS i FROM f)
SELECT l_orderkey, l_linenumber AS reviewer, CASE WHEN fit AND i = 1 THEN CASE WHEN reject THEN 'rejected' ELSE 'approved' END WHEN reject AND bare THEN 'comment_required' ELSE 'bad_state' END AS outcome,
CASE WHEN fit AND i = 1 THEN CASE WHEN reject THEN 'reject' ELSE 'approve' END END AS event, CASE WHEN fit AND i = 1 AND NOT reject THEN 'complete' END AS slot_event FROM n""")
def judged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts (line items) on submitted work (orders): the first that may be decides, as rows for the logs (MU-13)."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("reviewer"), F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("verdict"),
        F.when(F.col("l_tax") < 0.02, " ").otherwise("say").alias("comment"),
    )
    state = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "P", "under_review").otherwise("downloaded")
    states = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), state.alias("state"))
    return queue.judged(items, states, "l_orderkey").select("l_orderkey", "reviewer", "outcome", "event", "slot_event")


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') * 5 AS r, count(*) FILTER (l_returnflag = 'A') * 9 AS a, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderstatus, r, a, CASE WHEN o_orderkey % 7 = 0 THEN 'size_mismatch' WHEN o_orderkey % 11 = 0 THEN 'checksum_mismatch' WHEN r = 0 OR r <= 8 OR a BETWEEN 1 AND 8 THEN 'failed_validation' END AS bad,
(o_orderkey % 100) / 100.0 < 0.2 AS review, CASE WHEN o_orderkey % 10 = 3 THEN 'gold' ELSE 'normal' END AS kind FROM orders JOIN c ON l_orderkey = o_orderkey),
x AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN 'bad_state' WHEN bad IS NOT NULL THEN bad WHEN NOT review AND kind = 'normal' THEN 'approved' ELSE 'submitted' END AS outcome FROM o)
SELECT o_orderkey, outcome, CASE WHEN outcome IN ('approved', 'submitted') THEN review END AS needs_review, CASE outcome WHEN 'approved' THEN 'submit,approve' WHEN 'submitted' THEN 'submit' ELSE '' END AS events,
CASE WHEN outcome = 'approved' THEN 'complete' END AS slot_event, CASE WHEN outcome = 'failed_validation' THEN array_to_string(list_filter([CASE WHEN r = 0 THEN '- empty_required_segment: R' WHEN r <= 8 THEN '- stray_voxels: R' END,
CASE WHEN a BETWEEN 1 AND 8 THEN '- stray_voxels: A' END], lambda p: p IS NOT NULL), chr(10)) END AS why FROM x""")
def submit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions (orders) through state, upload, rules and sampling to log rows, with what blocks them (MU-12, FN-11)."""
    n = lambda f, k: (F.count_if(F.col("l_returnflag") == f) * k).alias(f)
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("R", 5), n("A", 9), F.sum("l_quantity").alias("seconds"), F.count("*").alias("size"))
    k = F.col("o_orderkey")
    work = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "downloaded").otherwise("submitted").alias("state")).join(items, "o_orderkey")
    problems = policy.check_submission(F.create_map(F.lit("R"), F.col("R"), F.lit("A"), F.col("A")), ["R"], ["A"], F.col("seconds"))
    digest = F.sha2(k.cast("string"), 256)
    given = work.select(
        "o_orderkey", "state", "size", F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("claimed_size"), digest.alias("digest"),
        F.when(k % 11 == 0, "00").when(k % 2 == 0, F.upper(digest)).alias("claimed_digest"), problems.alias("problems"),
        F.when(k % 10 == 3, policy.GOLD).otherwise(policy.NORMAL).alias("kind"), (k % 100 / 100).alias("roll"), F.lit(0.2).alias("rate"),
    )
    why = policy.summary(policy.blocking(F.col("problems")))
    return queue.submitted(given).select(
        "o_orderkey", "outcome", "needs_review", F.array_join("events", ",").alias("events"), "slot_event", F.when(F.col("outcome") == "failed_validation", why).alias("why")
    )


@query("SELECT event_id, kind FROM (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'gold' ELSE 'duplicate' END AS kind FROM events WHERE event_type IN ('click', 'error') AND value < 50) ORDER BY ts, event_id LIMIT 25")
def scores_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker's next batch (PF-9): oldest unscored gold and duplicate work."""
    kind = F.when(F.col("event_type") == "click", policy.GOLD).when(F.col("event_type") == "error", policy.DUPLICATE).otherwise(policy.NORMAL)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("submitted"), kind.alias("kind"), (F.col("value") >= 50).alias("scored"))
    return queue.worker_queue(rows).select(F.col("key").alias("event_id"), "kind")


@query("""SELECT o_orderkey, 'release' AS event, 'release' AS slot_event FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def release_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open work of disabled users (customers in debt) goes back (MU-10)."""
    state = F.when(F.col("o_orderstatus") == "O", "downloaded").when(F.col("o_orderstatus") == "P", "rejected").otherwise("approved")
    work = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), state.alias("state"))
    return queue.released_all(work, table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 10) ON p_partkey = l_partkey
LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey""")
def assignment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with case and file where there are any (JN-7)."""
    cases = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    files = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    work = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return work.join(cases, "l_partkey", "left").join(files, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("""SELECT l_orderkey, l_linenumber, p_size <= 5 AS gold, s_name AS gold_file FROM lineitem LEFT JOIN (SELECT p_partkey, p_size FROM part) ON p_partkey = l_partkey
LEFT JOIN supplier ON p_size <= 5 AND s_acctbal > 0 AND s_suppkey = p_partkey % 10 + 1""")
def gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with their case's reference file; cases that are not gold, and gold ones without a file, stay (JN-9, JN-3)."""
    part = table(spark, sf_dir, "part")
    cases = part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") <= 5).alias("gold"), F.when(F.col("p_size") <= 5, F.col("p_partkey") % 10 + 1).alias("s_suppkey"))
    files = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("gold_file"))
    work = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return work.join(cases, "l_partkey", "left").join(files, "s_suppkey", "left").select("l_orderkey", "l_linenumber", "gold", "gold_file")


DUE_SQL = """WITH a AS (SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS failures, max(epoch(ts)) AS last FROM events WHERE event_type = 'click' AND value < 60 GROUP BY ALL),
d AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' AND value >= 60), n AS (SELECT max(epoch(ts)) AS now FROM events)
SELECT event_id, coalesce(failures, 0) AS failures, CASE WHEN coalesce(failures, 0) >= 2 THEN 'dead' WHEN last + 86400 * 3 * power(2, failures - 1) > now THEN 'waiting' ELSE 'due' END AS status
FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.k = json_extract_string(e.props, '$.k') CROSS JOIN n
WHERE event_type IN ('error', 'view') AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = e.user_id AND d.k = json_extract_string(e.props, '$.k'))"""


@query(DUE_SQL)
def scores_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is owed a score after failed tries: due, waiting for its turn, or set aside (SM-10, PF-9)."""
    events = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", F.get_json_object("props", "$.k").alias("k")))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    kind = F.when(F.col("event_type") == "view", policy.GOLD).otherwise(policy.DUPLICATE)
    work = events.where("event_type IN ('view', 'error')").select("key", "event_id", F.col("ts").alias("submitted"), kind.alias("kind"))
    tries = events.where("event_type = 'click'").select("key", at.alias("at"), (F.col("value") >= 60).alias("ok"))
    now = events.agg(F.max(at).alias("now")).first()["now"]
    return queue.due_scores(work, tries, F.lit(now), most=2, wait=3 * 86400.0).select("event_id", "failures", "status")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events WHERE event_type <> 'purchase'""")
def resumable_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached work that was not submitted, newest first (PF-17)."""
    newest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").where("event_type != 'purchase'").select("user_id", "event_id", "ts")
    return rows.select("user_id", "event_id", F.row_number().over(newest).alias("place"))


@query("""SELECT n_name, count(DISTINCT o_custkey) AS patients, round(sum(l_extendedprice) / 1024, 3) AS gb, count(*) FILTER (l_returnflag = 'N') AS images, count(*) FILTER (l_returnflag <> 'N') AS labels
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def collection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients, gigabytes, and series of images and labels of a collection (AG-15)."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_returnflag")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    series = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(people, "o_custkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    image = F.col("l_returnflag") == "N"
    return series.groupBy("n_name").agg(
        F.count_distinct("o_custkey").alias("patients"), F.round(F.sum("l_extendedprice") / 1024, 3).alias("gb"), F.count_if(image).alias("images"), F.count_if(~image).alias("labels")
    )


@query("""SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, sum(n_chars) > 500000 AS over_cap FROM documents GROUP BY 1""")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of a folder (AG-24)."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return docs.withColumn("over_cap", F.col("bytes") > 500000)


@query("""WITH p AS (SELECT label AS run, max_by(vec_id, vec_id) AS vec_id, max_by(embedding, vec_id) AS e FROM embeddings GROUP BY 1),
s AS (SELECT run, vec_id, unnest(e)::DOUBLE AS score, generate_subscripts(e, 1) AS structure FROM p)
SELECT run, vec_id AS preview, structure::INTEGER AS structure, round(score, 6) AS score, place::INTEGER AS place, round(mean, 6) AS mean FROM
(SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, structure) AS place, avg(score) OVER (PARTITION BY run) AS mean FROM s) WHERE place <= 5""")
def weakest_in_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five weakest structures of each run's latest preview, and the mean over its map of scores (WN-8, SO-3, AG-20)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    last = queue.latest(rows, ["run"], ["vec_id"])
    m = F.map_from_arrays(F.sequence(F.lit(1), F.size("e")), F.col("e"))
    entries = F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct(x["value"].alias("score"), x["key"].alias("structure"))))
    mean = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x) / F.size(m)
    some = last.select("run", "vec_id", F.round(mean, 6).alias("mean"), F.posexplode(F.slice(entries, 1, 5)).alias("p", "x"))
    return some.select("run", F.col("vec_id").alias("preview"), "x.structure", F.round("x.score", 6).alias("score"), (F.col("p") + 1).alias("place"), "mean")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderkey) - 1 AS place FROM orders")
def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all work, pending before running (SO-10)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("late"))
    return ranks.placed(rows, [F.col("late"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("""SELECT p_partkey, p_brand = 'Brand#1' OR p_type LIKE 'LARGE%' AS expert, p_type LIKE '%TIN%' AS blocked FROM part WHERE (p_brand = 'Brand#1' OR p_type LIKE 'LARGE%') AND p_type NOT LIKE '%TIN%'""")
def expert_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of the catalogue (expert ones), without blocked licences (PF-13)."""
    expert, blocked = (F.col("p_brand") == "Brand#1") | F.col("p_type").startswith("LARGE"), F.col("p_type").contains("TIN")
    rows = table(spark, sf_dir, "part").select("p_partkey", expert.alias("expert"), blocked.alias("blocked"))
    return rows.where("expert AND NOT blocked")


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM customer),
v AS (SELECT c_custkey, (h % 360) / 360.0::DOUBLE AS hue, 0.55 + ((h >> 9) % 40) / 100.0 AS s, 0.70 + ((h >> 17) % 30) / 100.0 AS v FROM h),
p AS (SELECT c_custkey, floor(hue * 6)::INTEGER % 6 AS i, hue * 6 - floor(hue * 6) AS f, s, v FROM v)
SELECT c_custkey, round(CASE i WHEN 0 THEN v WHEN 1 THEN v * (1 - f * s) WHEN 2 THEN v * (1 - s) WHEN 3 THEN v * (1 - s) WHEN 4 THEN v * (1 - (1 - f) * s) ELSE v END, 6) AS red,
round(CASE i WHEN 0 THEN v * (1 - (1 - f) * s) WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN v * (1 - f * s) ELSE v * (1 - s) END, 6) AS green,
round(CASE i WHEN 0 THEN v * (1 - s) WHEN 1 THEN v * (1 - s) WHEN 2 THEN v * (1 - (1 - f) * s) WHEN 3 THEN v WHEN 4 THEN v ELSE v * (1 - f * s) END, 6) AS blue FROM p""")
def name_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable colour of each name (FN-28)."""
    colour = text.name_colour(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.round(colour[c], 6).alias(c) for c in ("red", "green", "blue")])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ball is structure 1 or 2 of its case; structure 3 is in no case."""
    a, b = (side.withColumn("label", (1 + F.col("s") % 2).cast("int")) for side in _balls(spark, sf_dir))
    found = voxels.score_cases(a, b, ["s"], (0.5, 0.5, 1.0), tolerance=0.75, labels=[1, 2, 3])
    return found.withColumns({c: F.round(c, 6) for c in ("dice", "nsd")})


@query(f"SELECT s, round(dice, 6) AS mean_dice, round(nsd, 6) AS mean_nsd, 1::BIGINT AS n_present, 3::BIGINT AS n_classes FROM ({SCORES})")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the structures a case has, of all that it could have (AG-11, VX-6, VX-7)."""
    found = voxels.case_summary(_scores(spark, sf_dir), ["s"])
    return found.select("s", F.round("mean_dice", 6).alias("mean_dice"), F.round("mean_nsd", 6).alias("mean_nsd"), "n_present", "n_classes")


@query(f"""WITH x AS ({SCORES}), r AS (SELECT l AS label, avg(dice) FILTER (s % 2 + 1 = l) AS dice, avg(nsd) FILTER (s % 2 + 1 = l) AS nsd, count(*) FILTER (s % 2 + 1 = l) AS n_cases_present, count(*) AS n_cases FROM x, (SELECT unnest([1, 2, 3]) AS l) GROUP BY l)
SELECT label, round(dice, 6) AS dice, round(nsd, 6) AS nsd, n_cases_present, n_cases, n_cases_present < 5 AS rare, row_number() OVER (ORDER BY dice NULLS LAST, label)::INTEGER AS place FROM r""")
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures by mean dice, absent ones last (AG-10, AG-13, SO-2)."""
    found = voxels.structure_report(_scores(spark, sf_dir))
    return found.select("label", F.round("dice", 6).alias("dice"), F.round("nsd", 6).alias("nsd"), "n_cases_present", "n_cases", "rare", "place")


@query("""SELECT c, label, n, first FROM (SELECT p_size AS c, l AS label, count(*) FILTER (l_linenumber = l) AS n, min((l_partkey, l_suppkey)) FILTER (l_linenumber = l) AS f FROM
(SELECT DISTINCT p_size, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey), (SELECT unnest([1, 2, 9]) AS l) GROUP BY 1, 2), LATERAL (SELECT f[1] AS first)""")
def structure_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask per case and structure, empty ones kept (VX-12): its size and first place."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("c"))
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").select("c", F.col("l_linenumber").alias("label"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.lit(0).alias("z"))
    return voxels.masks_of(rows, "c", [1, 2, 9]).select("c", "label", F.size("voxels").cast("bigint").alias("n"), F.get("voxels", F.lit(0))["x"].alias("first"))
