"""Places in an order over a whole table, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.session import kept


def placed(df: DataFrame, order: list[Column], **weights: str | None) -> DataFrame:
    """df with a column for each of `weights` (default: place): how much of the named column, or how many rows (None), come before a row in the order.

    The order must tell all rows apart. Rows are dealt by ranges of it; the sums of the ranges (one row
    each) give every range its offset, and a window inside each range does the rest. The dealt rows are
    kept, so both uses see the same ranges.
    """
    weights = weights or {"place": None}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    own = {out: F.col(w) if w else F.lit(1) for out, w in weights.items()}
    sums = dealt.groupBy("_range").agg(*[F.sum(x).cast("bigint").alias(f"_of_{out}") for out, x in own.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_of_{out}").over(before), F.lit(0)).alias(f"_to_{out}") for out in own])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(starts), "_range")  # one row a range
    for out, x in own.items():
        ranked = ranked.withColumn(out, (F.col(f"_to_{out}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).cast("bigint"))
    return ranked.drop("_range", *[f"_to_{out}" for out in own])
