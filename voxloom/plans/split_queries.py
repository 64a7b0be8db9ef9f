"""Splits, folds and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.splits import assign_split, lumpy
from voxloom.operators import folds
from voxloom.plans.base import query
from voxloom.session import table

AT = "(('0x' || substr(sha256('12345:' || doc_id::varchar), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0"
SPLIT = f"CASE WHEN {AT} < 0.15 THEN 'test' WHEN {AT} < 0.3 THEN 'val' ELSE 'train' END"
FOLDS = """strata AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS s FROM documents GROUP BY lang),
folded AS (SELECT doc_id, lang, CAST((row_number() OVER (ORDER BY s, sha256('12345:' || doc_id::varchar)) - 1) % 5 AS INTEGER) AS fold
  FROM documents JOIN strata USING (lang))"""


@query(f"SELECT {SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1")
def hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.groupBy(assign_split(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))


@query(f"""SELECT CASE WHEN toxic = 1 THEN 'test' ELSE {SPLIT} END AS split, coalesce(toxic = 1, false) AS overridden, count(*) AS n
FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id) GROUP BY 1, 2""")
def split_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    forced = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("test").alias("split"))
    return folds.with_overrides(docs, forced, "doc_id", assign_split(F.col("doc_id"))).groupBy("split", "overridden").agg(F.count("*").alias("n"))


@query(f"WITH {FOLDS} SELECT doc_id, fold FROM folded")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return folds.stratified_folds(docs, "doc_id", "lang").select("doc_id", "fold")


@query(f"""WITH {FOLDS}, n AS (SELECT lang, fold, count(*) AS n FROM folded GROUP BY ALL)
SELECT lang, min(n) AS least, max(n) AS most, max(n) - min(n) <= 1 AS balanced FROM n GROUP BY lang""")
def fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    per = folds.stratified_folds(docs, "doc_id", "lang").groupBy("lang", "fold").agg(F.count("*").alias("n"))
    least = per.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return least.withColumn("balanced", F.col("most") - F.col("least") <= 1)


@query(f"""WITH pool AS (SELECT doc_id, lang FROM documents WHERE {SPLIT} <> 'test'),
{FOLDS.replace("FROM documents", "FROM pool")},
m AS (SELECT g.fold, CASE WHEN f.fold = g.fold THEN 'val' ELSE 'train' END AS role, doc_id FROM folded f, (SELECT DISTINCT fold FROM folded) g),
l AS (SELECT fold, role, doc_id FROM m UNION ALL SELECT fold, 'val', doc_id FROM m WHERE role = 'train' AND doc_id % 97 = fold UNION ALL SELECT 3, 'train', doc_id FROM documents WHERE {SPLIT} = 'test' AND doc_id % 5 = 0),
k AS (SELECT fold, doc_id, bool_or(role = 'train') AS t, bool_or(role = 'val') AS v FROM l GROUP BY ALL),
r AS (SELECT fold, count(*) FILTER (t) AS n_train, count(*) FILTER (v) AS n_val, count(*) FILTER (t AND v) AS in_both,
count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE {SPLIT} = 'test')) AS in_test FROM k GROUP BY fold)
SELECT *, in_both = 0 AND in_test = 0 AND n_val > 0 AS ok FROM r""")
def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks that were put into the folds, counted: some training rows also validate, some test rows train in fold 3 (ST-1, ST-2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", assign_split(F.col("doc_id")).alias("split"))
    members = folds.fold_members(folds.stratified_folds(docs.where("split != 'test'"), "doc_id", "lang"), "doc_id")
    twice = members.where("role = 'train' AND doc_id % 97 = fold").withColumn("role", F.lit("val"))
    test = docs.where("split = 'test'")
    stray = test.where("doc_id % 5 = 0").select(F.lit(3).alias("fold"), F.lit("train").alias("role"), "doc_id")
    return folds.leak_report(members.unionByName(twice).unionByName(stray), test, "doc_id")


@query(f"""SELECT split, count(*) AS n_listed, count(l) AS n_kept, count(*) - count(l) AS n_dropped
FROM (SELECT {SPLIT} AS split, doc_id FROM documents) LEFT JOIN (SELECT doc_id, 1 AS l FROM labels) USING (doc_id) GROUP BY split""")
def available_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", assign_split(F.col("doc_id")).alias("split"))
    return folds.restricted(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH s AS (SELECT {SPLIT} AS split, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM documents GROUP BY 1)
SELECT split, n, total, total < 60 AND abs(n - total * CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) > 0.5 + 0.5 * total * CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS lumpy FROM s""")
def split_lumpiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a small sample's split strays far from its share (FN-3)."""
    counts = hash_split_counts(spark, sf_dir)
    total = counts.agg(F.sum("n").alias("total"))
    share = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    return counts.join(F.broadcast(total)).withColumn("lumpy", lumpy(F.col("n"), F.col("total"), share))


@query(f"""SELECT doc_id FROM documents WHERE {SPLIT} = 'val'""")
def split_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one split (PF-1)."""
    return table(spark, sf_dir, "documents").where(assign_split(F.col("doc_id")) == "val").select("doc_id")


@query("""WITH t AS (SELECT max(p_partkey) AS total FROM part), g AS (SELECT g AS grp FROM range(7) r(g)), c AS (SELECT p_partkey % 7 AS grp, count(*) AS n FROM part WHERE p_size <> 50 GROUP BY 1)
SELECT grp, coalesce(n, 0) AS n, total // 7 + CAST(grp < total % 7 AS BIGINT) AS expected, coalesce(n, 0) = total // 7 + CAST(grp < total % 7 AS BIGINT) AS as_expected FROM g CROSS JOIN t LEFT JOIN c USING (grp)""")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes against those that the whole table's numbers promise (AG-25); parts of one size are missing."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("grp"), "p_partkey", "p_size")
    total = part.agg(F.max("p_partkey").alias("total")).first()["total"]
    return folds.size_report(part.where("p_size != 50"), "grp", F.lit(total), 7)


@query("""SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_right, b.k IS NULL AS only_left FROM
(SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one set only (ST-3)."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("a")).distinct()
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full").where("a IS NULL OR b IS NULL")
    return both.select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("only_right"), F.col("b").isNull().alias("only_left"))
