"""Folds and splits: stratified round-robin folds, leak checks, restrictions, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distributed_rank(df: DataFrame, by: list[str], digest: str, out: str, width: int = 2) -> DataFrame:
    """df with `out`: 0-based rank over (by, digest), without one task seeing all rows of a `by` group.

    `digest` is a hexadecimal hash: its first `width` digits cut every group into even cells, whose
    counts (16^width per group at most) give the offset of each cell; rows are ranked in their cell.
    """
    cells = df.withColumn("_cell", F.substring(digest, 1, width))
    order = [*by, "_cell"]
    sizes = cells.groupBy(*order).agg(F.count("*").alias("_n"))
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*order).orderBy(digest)
    ranked = cells.join(starts, order).withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
    return ranked.drop("_cell", "_start")


def stratified_folds(df: DataFrame, key: str, stratum: str, folds: int = 5, seed: int = 12345) -> DataFrame:
    """df with `fold`: strata from large to small (ties by name), members in hash order, one running cursor modulo folds.

    A stratum's fold sizes differ by one at most. The order inside a stratum is that of
    sha256('seed:key'), so it does not depend on the input order. Rows without a stratum are a stratum, named 'unknown'
    among ties; rows without a key come first in theirs.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    order = W.orderBy(F.desc("_size"), F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")), F.col(stratum).isNull())
    ranks = sizes.withColumn("_stratum", F.row_number().over(order)).select(F.col(stratum).alias("_name"), "_stratum")
    digest = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.lit("00"))
    placed = df.join(ranks, F.col(stratum).eqNullSafe(F.col("_name"))).drop("_name").withColumn("_digest", digest)
    ranked = distributed_rank(placed, ["_stratum"], "_digest", "_at")
    return ranked.withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_at", "_stratum", "_digest")


def size_report(df: DataFrame, group: str, total: Column, groups: int) -> DataFrame:
    """(group, n, expected, as_expected) of groups numbered from 0 that should share `total` rows evenly, the first ones one more each.

    total: an aggregate over df, e.g. F.max of the last member's number. Groups without rows are listed with n 0.
    """
    whole = df.agg(total.cast("bigint").alias("_total"))
    every = df.sparkSession.range(groups).select(F.col("id").alias(group)).join(F.broadcast(whole))
    expected = F.floor(F.col("_total") / groups) + (F.col(group) < F.col("_total") % groups).cast("int")
    counts = df.groupBy(F.col(group).cast("bigint").alias(group)).agg(F.count("*").alias("n"))
    listed = every.join(counts, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), expected.alias("expected"))
    return listed.withColumn("as_expected", F.col("n") == F.col("expected"))


def fold_members(folded: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """(fold, role, key): a row is validation in its own fold and training in all others."""
    crossed = folded.select(key, "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_f"))
    role = F.when(F.col("_f") == F.col("fold"), "val").otherwise("train")
    return crossed.select(F.col("_f").alias("fold"), role.alias("role"), key)


def leak_report(members: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """(fold, n_train, n_val, in_both, in_test, ok) of fold members (fold, role, key) against the test keys."""
    marked = members.join(held_out.select(key).distinct().withColumn("_test", F.lit(1)), key, "left")
    by_key = marked.groupBy("fold", key).agg(
        F.count_if(F.col("role") == "train").alias("t"), F.count_if(F.col("role") == "val").alias("v"), F.max("_test").alias("x")
    )
    report = by_key.groupBy("fold").agg(
        F.count_if(F.col("t") > 0).alias("n_train"),
        F.count_if(F.col("v") > 0).alias("n_val"),
        F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("in_both"),
        F.count_if(F.col("x") == 1).alias("in_test"),
    )
    return report.withColumn("ok", (F.col("in_both") == 0) & (F.col("in_test") == 0) & (F.col("n_val") > 0))


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, assigned: Column) -> DataFrame:
    """df with `split` (the override's where there is one, else assigned) and `overridden`."""
    own = overrides.select(key, F.col("split").alias("_own")).dropDuplicates([key])
    return (
        df.join(own, key, "left")
        .withColumn("split", F.coalesce("_own", assigned))
        .withColumn("overridden", F.col("_own").isNotNull())
        .drop("_own")
    )


def restricted(members: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """(split, n_listed, n_kept, n_dropped): members per split that are available."""
    found = members.join(available.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    report = found.groupBy("split").agg(F.count("*").alias("n_listed"), F.count("_there").alias("n_kept"))
    return report.withColumn("n_dropped", F.col("n_listed") - F.col("n_kept"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on several rows, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def group_partition_report(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that stand in several groups, or in none (a null group)."""
    per = df.groupBy(member).agg(F.countDistinct(group).alias("n_groups"))
    return per.where("n_groups != 1")
