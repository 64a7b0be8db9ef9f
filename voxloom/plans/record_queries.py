"""Submissions, verdicts, settings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import records
from voxloom.operators import folds
from voxloom.plans.base import query
from voxloom.plans.split_queries import FOLDS
from voxloom.session import table
from voxloom.sources import reports


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON list_contains([c_nationkey, (c_nationkey + 1) % 25], n_nationkey)""")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the groups their array names (JN-11): the array is exploded, so the join is by equality."""
    groups = F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).alias("n_nationkey")
    users = table(spark, sf_dir, "customer").select("c_custkey", groups)
    return users.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("c_custkey", "n_name")


@query("""SELECT vec_id, CASE WHEN label % 2 = 0 THEN round(embedding[2]::DOUBLE, 6) END AS b FROM embeddings""")
def zipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by name, only where names and values agree in number (JN-14)."""
    values = F.when(F.col("label") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.slice("embedding", 1, 2))
    m = records.zipped(F.array(F.lit("a"), F.lit("b"), F.lit("c")), values)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.try_element_at(m, F.lit("b")).cast("double"), 6).alias("b"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_tax >= 0.08)")
def ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are not there yet (JN-18, MU-11)."""
    known = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_tax >= 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(known, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value < 30 THEN 'refused' WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END AS outcome FROM events WHERE event_type IN ('error', 'purchase')""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejection needs a comment, else nothing happens (MU-13); low values stand for missing comments."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    rejected = F.col("event_type") == "error"
    return rows.select("event_id", F.when(rejected & (F.col("value") < 30), "refused").when(rejected, "rejected").otherwise("approved").alias("outcome"))


@query("""SELECT l_orderkey, min(l_shipdate)::DATE::VARCHAR AS since FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1 HAVING bool_and(l_tax < 0.08) AND count(*) FILTER (l_discount > 0.09) = 0""")
def auto_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored work that nobody must see (MU-14)."""
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_discount", "l_shipdate").join(waiting, "l_orderkey", "left_semi")
    per = rows.groupBy("l_orderkey").agg(F.bool_and(F.col("l_tax") < 0.08).alias("fine"), F.count_if(F.col("l_discount") > 0.09).alias("flags"), F.min("l_shipdate").alias("since"))
    return per.where("fine AND flags = 0").select("l_orderkey", F.date_format("since", "yyyy-MM-dd").alias("since"))


@query("SELECT user_id, max(event_id) FILTER (event_type = 'view') AS heartbeat, count(*) FILTER (event_type IN ('signup', 'view', 'error')) AS open FROM events GROUP BY 1")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last heartbeat and open work of a user (MU-6, PF-7)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return rows.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("heartbeat"),
        F.count_if(F.col("event_type").isin("signup", "view", "error")).alias("open"),
    )


@query("""SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'organs' WHEN p_type LIKE 'SMALL%' THEN 'vessels' WHEN p_type = 'PROMO TIN' THEN 'muscles' ELSE 'other' END AS grp, p_size > 40 AS too_coarse FROM part""")
def group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by ordered rules, and spacings over a limit (FN-17, FN-21)."""
    rules = [("STANDARD*", "organs"), ("SMALL*", "vessels"), ("PROMO TIN", "muscles")]
    coarse = records.spacing_warning(F.array(F.col("p_size"), F.lit(1)), F.lit(40))
    return table(spark, sf_dir, "part").select("p_partkey", records.by_rules(F.col("p_type"), rules, "other").alias("grp"), coarse.alias("too_coarse"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'flag' END, CASE WHEN c_custkey % 3 = 0 THEN 'env' END, c_mktsegment) AS setting, c_custkey % 5 <> 4 AS served,
CASE WHEN c_custkey % 5 < 2 THEN 'busy' END AS code FROM customer""")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedence of settings, the version gate and error bodies of either form (FN-22, FN-26)."""
    k = F.col("c_custkey") % 5
    body = F.when(k == 0, '{"code": "busy", "message": "m"}').when(k == 1, '{"error": {"code": "busy"}}').otherwise("[]")
    version = F.when(k == 4, 7).when(k == 3, 1)
    given = records.first_given(F.when(F.col("c_custkey") % 2 == 0, "flag"), F.when(F.col("c_custkey") % 3 == 0, "env"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", given.alias("setting"), records.protocol_ok(version).alias("served"), records.error_of(body)["code"].alias("code"))


@query("""SELECT l_orderkey AS label_set, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous, count(DISTINCT l_partkey) = count(*) AS unique_names,
count(DISTINCT l_suppkey) = count(*) AND min(l_suppkey) <> 0 AS source_injective FROM lineitem GROUP BY 1""")
def label_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether label sets have indices 1 to N and unique names (FN-24)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label_set"), "l_linenumber", "l_partkey", "l_suppkey")
    return records.label_set_report(rows, "label_set", "l_partkey", "l_linenumber", "l_suppkey")


@query(f"""WITH {FOLDS}, m AS (SELECT g.fold, CASE WHEN f.fold = g.fold THEN 'val' ELSE 'train' END AS role, doc_id FROM folded f, (SELECT DISTINCT fold FROM folded) g)
SELECT fold, role, doc_id::VARCHAR AS key FROM m""")
def folds_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds written as JSON and read again (SC-11, SC-12, SO-9)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    members = folds.fold_members(folds.stratified_folds(docs, "doc_id", "lang"), "doc_id")
    return reports.folds_from_json(reports.folds_as_json(members.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id"))


@query("""SELECT user_id, round(avg(value), 6) AS mean_dice, list_sort(list(event_id ORDER BY event_id DESC)[1:5]) AS last_five FROM events WHERE event_type = 'click' GROUP BY 1""")
def preview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a preview's map of scores, and the last five messages (AG-20, SO-7)."""
    back = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", "value", F.row_number().over(back).alias("r"))
    return rows.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_dice"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("event_id")))).alias("last_five"))


@query("""(SELECT 'train' AS side, o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 40) UNION ALL (SELECT 'test', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5)""")
def limited_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 40 on one side and an eighth of it on the other, in key order (SO-8)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    side = lambda name, rows, n: rows.orderBy("o_orderkey").limit(n).select(F.lit(name).alias("side"), "o_orderkey")
    return side("train", orders.where("o_orderstatus != 'P'"), 40).unionByName(side("test", orders.where("o_orderstatus = 'P'"), max(1, 40 // 8)))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1 OR r = n OR r = n // 2 + 1""")
def sampled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last member of a group, as a validation samples them (AG-23)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    w = W.partitionBy("o_custkey")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(w))
    return ranked.where((F.col("r") == 1) | (F.col("r") == F.col("n")) | (F.col("r") == F.floor(F.col("n") / 2) + 1)).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_approved, sum(o_totalprice) > 500000 AS over_cap FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def first_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First approved work of a case, and whether a sum exceeds a cap (WN-11, AG-24)."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_approved"), (F.sum("o_totalprice") > 500000).alias("over_cap"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (o_orderdate >= TIMESTAMP '1997-06-01' OR l_shipdate >= TIMESTAMP '1998-01-01') AND o_orderstatus IN ('F', 'O')""")
def export_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work decided or submitted since a date, in a selectable state (PF-11, PF-12)."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate")
    since = "o_orderdate >= TIMESTAMP_NTZ '1997-06-01 00:00:00' OR l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'"
    return orders.join(items, "o_orderkey").where(since).select("o_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100""")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an ordered table (SC-19)."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(100).limit(50)


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7 OR s_name = 'Supplier#000000003' OR s_name || '_fast' = 'Supplier#000000005_fast'""")
def task_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task by id, name or full name (FN-23)."""
    return table(spark, sf_dir, "supplier").where(
        (F.col("s_suppkey") == 7) | (F.col("s_name") == "Supplier#000000003") | (F.concat("s_name", F.lit("_fast")) == "Supplier#000000005_fast")
    ).select("s_suppkey", "s_name")


@query("""SELECT p_partkey, CASE WHEN p_size <= 2 THEN p_size * 10 ELSE 0 END AS source FROM part""")
def inverted_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in an inverted map with 0 as default (FN-31)."""
    m = records.inverted(F.create_map(F.lit(10), F.lit(1), F.lit(20), F.lit(2)))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(m, F.col("p_size")), F.lit(0)).alias("source"))


@query("""SELECT event_id, user_id, ts, value FROM events""")
def annotator_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assignments as an annotator may see them, without their kind; the scan reads the other columns only (PF-14, PF-15)."""
    work = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value")
    return records.seen_by(work, admin=False)


@query("""SELECT event_id, user_id, ts, event_type AS kind, value FROM events""")
def admin_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as an administrator sees them (PF-15)."""
    work = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), "value")
    return records.seen_by(work, admin=True)
