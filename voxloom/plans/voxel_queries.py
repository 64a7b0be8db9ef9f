"""Scores of labellings: balls on a grid (one case per nation), and a sparse grid made of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import bricks, distances, voxels
from voxloom.plans.base import query
from voxloom.session import table

BALLS = """grid AS (SELECT x::INTEGER AS x, y::INTEGER AS y, z::INTEGER AS z FROM range(12) a(x), range(12) b(y), range(8) c(z)),
a AS (SELECT n_nationkey AS s, x, y, z FROM nation, grid WHERE (x - 5) * (x - 5) + (y - 5) * (y - 5) + (z - 4) * (z - 4) <= (2 + n_nationkey % 3) * (2 + n_nationkey % 3)),
b AS (SELECT n_nationkey AS s, x, y, z FROM nation, grid WHERE (x - 5 - n_nationkey % 3) * (x - 5 - n_nationkey % 3) + (y - 5) * (y - 5) + (z - 4) * (z - 4) <= (2 + n_nationkey % 3) * (2 + n_nationkey % 3)),
"""
SURFACE = """SELECT s, x, y, z FROM {m} v WHERE (SELECT count(*) FROM {m} w WHERE w.s = v.s AND abs(w.x - v.x) + abs(w.y - v.y) + abs(w.z - v.z) = 1) < 6"""
SCORES = f"""WITH {BALLS} sa AS ({SURFACE.format(m='a')}), sb AS ({SURFACE.format(m='b')}),
d AS (SELECT sa.s, 0 AS side, min(sqrt(0.25 * (sa.x - sb.x) * (sa.x - sb.x) + 0.25 * (sa.y - sb.y) * (sa.y - sb.y) + (sa.z - sb.z) * (sa.z - sb.z))) AS d FROM sa JOIN sb USING (s) GROUP BY sa.s, sa.x, sa.y, sa.z
UNION ALL SELECT sb.s, 1, min(sqrt(0.25 * (sa.x - sb.x) * (sa.x - sb.x) + 0.25 * (sa.y - sb.y) * (sa.y - sb.y) + (sa.z - sb.z) * (sa.z - sb.z))) FROM sb JOIN sa USING (s) GROUP BY sb.s, sb.x, sb.y, sb.z),
n AS (SELECT s, (SELECT count(*) FROM a WHERE a.s = k.s) AS na, (SELECT count(*) FROM b WHERE b.s = k.s) AS nb, (SELECT count(*) FROM a JOIN b USING (s, x, y, z) WHERE s = k.s) AS i FROM (SELECT DISTINCT s FROM a) k)
SELECT s, round(2 * i / (na + nb), 6) AS dice, round((SELECT avg(CASE WHEN d <= 0.75 THEN 1.0 ELSE 0.0 END) FROM d WHERE d.s = n.s), 6) AS nsd,
round(greatest((SELECT quantile_cont(d, 0.95) FROM d WHERE d.s = n.s AND side = 0), (SELECT quantile_cont(d, 0.95) FROM d WHERE d.s = n.s AND side = 1)), 6) AS hd95 FROM n"""
SPARSE = """m AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS label, l_partkey % 97 AS x, l_suppkey % 89 AS y, l_linenumber AS z
FROM lineitem)"""


def _balls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = nations.select("s", axis(12).alias("x")).select("*", axis(12).alias("y")).select("*", axis(8).alias("z")).withColumn("label", F.lit(1))
    inside = lambda shift: (F.col("x") - 5 - shift) ** 2 + (F.col("y") - 5) ** 2 + (F.col("z") - 4) ** 2 <= (2 + F.col("s") % 3) ** 2
    return grid.where(inside(F.lit(0))), grid.where(inside(F.col("s") % 3))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return items.select(label.alias("label"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 89).alias("y"), F.col("l_linenumber").alias("z"))


@query("""SELECT source, sum(quality)::BIGINT AS voxels_a, sum(toxic)::BIGINT AS voxels_b, sum(quality * toxic)::BIGINT AS both,
round(2 * sum(quality * toxic) / nullif(sum(quality) + sum(toxic), 0), 6) AS dice FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def pairwise_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice of two labels over the documents of a source (VX-1)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    mask = lambda c: rows.where(f"{c} = 1").select("source", F.lit(1).alias("label"), F.col("doc_id").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    return voxels.dice(mask("quality"), mask("toxic"), ["source"]).select("source", "voxels_a", "voxels_b", "both", F.round("dice", 6).alias("dice"))


@query(f"WITH {BALLS} sa AS ({SURFACE.format(m='a')}) SELECT s, count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(z)::BIGINT AS z FROM sa GROUP BY s")
def surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voxels.surface(_balls(spark, sf_dir)[0], ["s"])
    return found.groupBy("s").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"])


@query(SCORES)
def nsd_hd95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and surface scores of each ball against its shifted twin (VX-3 to VX-7)."""
    a, b = _balls(spark, sf_dir)
    found = voxels.score_cases(a, b, ["s"], (0.5, 0.5, 1.0), tolerance=0.75)
    return found.select("s", *[F.round(c, 6).alias(c) for c in ("dice", "nsd", "hd95")])


@query(f"""WITH {SPARSE}, sizes AS (SELECT label, count(*) AS n FROM m GROUP BY 1),
v AS (SELECT x, y, z, min_by(label, (n, label)) AS label, count(*) - 1 AS more FROM m JOIN sizes USING (label) GROUP BY x, y, z)
SELECT label, count(*) AS voxels, sum(more)::BIGINT AS collisions FROM v GROUP BY label""")
def overlap_smaller_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that each label keeps, and the claims of others on them (VX-8, VX-9)."""
    found = bricks.merged(bricks.packed(_claims(spark, sf_dir), ["label"]), [])
    # what a label lost counts where it was kept: each brick's claims less its voxels
    kept = found.select("label", *bricks.BRICK, "bits")
    lost = found.where("lost != 0").select(*bricks.BRICK, "lost")
    more = kept.join(lost, bricks.BRICK).groupBy("label").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("lost")))).alias("collisions"))
    return bricks.counts(kept, ["label"]).withColumnRenamed("n", "voxels").where("voxels > 0").join(more, "label", "left").na.fill(0, ["collisions"])


@query(f"WITH {SPARSE} SELECT label, count(*) AS voxels FROM (SELECT x, y, z, max(label) AS label FROM m GROUP BY x, y, z) GROUP BY label")
def overlap_label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bricks.merged(bricks.packed(_claims(spark, sf_dir), ["label"]), [], "label_order")
    return bricks.counts(found, ["label"]).withColumnRenamed("n", "voxels").where("voxels > 0")


MARKED = """v AS (SELECT DISTINCT l_suppkey AS c, l_linenumber AS label, l_partkey % 61 AS x, l_orderkey % 53 AS y, l_quantity::BIGINT AS z FROM lineitem)"""


def _marked(spark: SparkSession, sf_dir: str, **what: Column) -> DataFrame:
    """Bricks of a sparse label volume for each supplier, with a mask for each value of `what`."""
    place = [F.col("l_partkey") % 61, F.col("l_orderkey") % 53, F.col("l_quantity").cast("bigint")]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c"), *[v.alias(k) for k, v in what.items()], *[p.alias(k) for p, k in zip(place, "xyz", strict=True)])
    return bricks.packed(rows, ["c", *what])


@query(f"""WITH {MARKED}, t AS (SELECT c, label, CASE label WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 5 THEN 7 END AS t, x, y, z FROM v), k AS (SELECT DISTINCT c FROM v)
SELECT c, (SELECT count(*) FROM (SELECT DISTINCT x, y, z FROM t WHERE t.c = k.c AND t.t = 7)) AS n7, (SELECT count(*) FROM t WHERE t.c = k.c AND t.t = 3) AS n3,
coalesce((SELECT string_agg(label || ':' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM t WHERE t.c = k.c AND t.t IS NULL GROUP BY label)), '') AS dropped,
(SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM (SELECT unnest([3, 4, 7]) AS m) WHERE m NOT IN (SELECT t.t FROM t WHERE t.c = k.c AND t.t IS NOT NULL)) AS missing FROM k""")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's volume with labels replaced; what is dropped and what is missing (VX-10)."""
    known, report = bricks.remapped(_marked(spark, sf_dir, label=F.col("l_linenumber")), ["c"], {1: 7, 2: 3, 5: 7, 99: 4})
    n = bricks.counts(known, ["c", "label"])
    per = n.groupBy("c").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (7, 3)])
    said = F.concat_ws(",", F.transform("unmapped", lambda u: F.concat_ws(":", u["label"].cast("string"), u["voxels"].cast("string"))))
    out = report.select("c", said.alias("dropped"), F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"))
    return out.join(per, "c", "left").na.fill(0, ["n7", "n3"])


NEAR = f"""WITH {MARKED}, m AS (SELECT c, label % 2 AS side, x, y, z FROM v), u AS (SELECT DISTINCT * FROM m),
f AS (SELECT c, side, x, y, z FROM u a WHERE (SELECT count(*) FROM u b WHERE b.c = a.c AND b.side = a.side AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1) < 6),
d AS (SELECT p.c, p.side, p.x, p.y, p.z, min(sqrt(0.64 * (p.x - q.x) * (p.x - q.x) + 0.64 * (p.y - q.y) * (p.y - q.y) + 2.25 * (p.z - q.z) * (p.z - q.z))) AS d FROM f p JOIN f q ON p.c = q.c AND p.side <> q.side GROUP BY ALL),
s AS (SELECT c, side, quantile_cont(d, 0.95) AS far FROM d GROUP BY ALL)
SELECT c, count(*) AS n, round(avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0.0 END), 6) AS nsd, round((SELECT max(far) FROM s WHERE s.c = d.c), 6) AS hd95 FROM d GROUP BY c"""


@query(NEAR)
def surface_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the surfaces of two masks of every supplier, made of all line items (VX-2 to VX-5)."""
    found = bricks.surface(_marked(spark, sf_dir, side=F.col("l_linenumber") % 2), ["c", "side"])
    a, b = (found.where(F.col("side") == k).drop("side") for k in (0, 1))
    scores = distances.surface_scores(a, b, ["c"], (0.8, 0.8, 1.5), tolerance=3)
    return scores.select("c", "n", F.round("nsd", 6).alias("nsd"), F.round("hd95", 6).alias("hd95")).where("hd95 < double('inf')")


@query("""SELECT c, label, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_size AS c FROM part JOIN lineitem ON l_partkey = p_partkey) CROSS JOIN (SELECT unnest([1, 2, 9]) AS label)
LEFT JOIN (SELECT p_size AS c, l_linenumber AS label, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) USING (c, label)""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each case and label of a set, zero-filled (AG-22, VX-12, AG-21)."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("c"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("label")).join(parts, "l_partkey")
    return voxels.label_counts(rows, "c", [1, 2, 9])


_M = "embedding[{}]::DOUBLE"
_DOT = lambda a, b: "(" + " + ".join(f"{_M.format(3 * r + a + 1)} * {_M.format(3 * r + b + 1)}" for r in range(3)) + ")"


@query("SELECT vec_id, round(greatest(" + ", ".join(f"abs({_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)})) - {float(a == b)})" for a in range(3) for b in range(a, 3)) + "), 6) AS error FROM embeddings")
def direction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(voxels.direction_error(F.col("embedding")), 6).alias("error"))


_GAP = lambda p, r: "(" + " + ".join(f"({_M.format(4 * r + c + 1)} - {_M.format(4 * r + c + 13)}) * {p[c]}" for c in range(4)) + ")"
_CORNERS = [(x, y, z, 1) for x in (0, 99) for y in (0, 79) for z in (0, 49)]


@query("SELECT vec_id, round(greatest(" + ", ".join(f"sqrt({' + '.join(f'{_GAP(p, r)} * {_GAP(p, r)}' for r in range(3))})" for p in _CORNERS) + "), 4) AS offset_mm FROM embeddings")
def affine_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a, b = F.slice("embedding", 1, 12), F.slice("embedding", 13, 12)
    return rows.select("vec_id", F.round(voxels.affine_offset(a, b, (100, 80, 50)), 4).alias("offset_mm"))


@query()
def orthonormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions made orthonormal (VX-14); their error afterwards is tested to be below 1e-12."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", voxels.orthonormalised(F.slice("embedding", 1, 9)).alias("fixed"))
    return rows.withColumn("error", voxels.direction_error(F.col("fixed")))


@query("""WITH d AS (SELECT l_suppkey, l_quantity - l_linenumber * 7 AS d FROM lineitem), k AS (SELECT l_suppkey, abs(d) AS m, count(*) AS k, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY l_suppkey ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rank FROM k)
SELECT l_suppkey, n, CASE WHEN n >= 6 THEN least(p, q) END AS w FROM (SELECT l_suppkey, count(*) AS n FROM d GROUP BY 1) LEFT JOIN
(SELECT l_suppkey, sum(rank * up)::DOUBLE AS p, sum(rank * (k - up))::DOUBLE AS q FROM r GROUP BY 1) USING (l_suppkey)""")
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_linenumber") * 7).cast("double").alias("b"))
    return voxels.signed_rank(rows, ["l_suppkey"], "l_quantity", "b").drop("p")


@query("""SELECT source, round(avg(quality), 6) AS mean_quality, round(avg(toxic), 6) AS mean_toxic, count(*) FILTER (toxic = 1) AS n_present, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY round(avg(quality), 6), source LIMIT 10""")
def weakest_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten structures with the lowest mean (AG-10, SO-1)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    means = rows.groupBy("source").agg(
        F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.avg("toxic"), 6).alias("mean_toxic"), F.count_if(F.col("toxic") == 1).alias("n_present"), F.count("*").alias("n")
    )
    return means.orderBy(F.col("mean_quality").asc_nulls_last(), "source").limit(10)


@query("""SELECT round(avg(toxic), 6) AS micro, round((SELECT avg(m) FROM (SELECT avg(toxic) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source)), 6) AS macro FROM labels JOIN documents USING (doc_id)""")
def micro_vs_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all pairs is not the mean of the structures' means (AG-12)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("toxic").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"))


@query("SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) FILTER (toxic = 1) < 3")
def rare_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures present in few cases (AG-13)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("n")).where("n < 3").select("source")


@query("""SELECT count(*) FILTER (l_returnflag = 'R') AS n_train, count(*) FILTER (l_returnflag = 'A') AS n_test, count(*) FILTER (l_tax > 0.07) AS n_skipped, max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS worst_case,
round(max(l_extendedprice), 2) AS worst FROM lineitem""")
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a conversion and its worst case (AG-14)."""
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_train"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_test"),
        F.count_if(F.col("l_tax") > 0.07).alias("n_skipped"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("worst_case"),
        F.round(F.max("l_extendedprice"), 2).alias("worst"),
    )
