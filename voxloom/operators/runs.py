"""Training logs: rows (run, pos, t, event, payload) folded to the state of each run in log order.

`pos` is the place in the log; order is always that, whatever the clock in `t` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KNOWN = ("run_start", "epoch", "checkpoint", "preview", "log", "run_end")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def run_states(log: DataFrame, run: str = "run", pos: str = "pos") -> DataFrame:
    """(run, started_at, finished, status, n_epochs, n_checkpoints, n_previews, n_messages, last_event_time, current_epoch).

    A later run_start sets the run running again but clears no earlier rows; unknown kinds only
    move last_event_time. One grouped aggregate: no log is gathered.
    """
    kind, at = F.col("event"), F.col(pos)
    of = lambda k: kind == k
    ends = log.groupBy(run).agg(
        F.max_by("t", F.when(of("run_start"), at)).alias("started_at"),
        F.max(F.when(of("run_start"), at)).alias("_start"),
        F.max(F.when(of("run_end"), at)).alias("_end"),
        F.max_by(F.coalesce("status", F.lit("completed")), F.when(of("run_end"), at)).alias("_status"),
        *[F.count_if(of(k)).alias(n) for k, n in (("epoch", "n_epochs"), ("checkpoint", "n_checkpoints"), ("preview", "n_previews"), ("log", "n_messages"))],
        F.max_by("t", F.when(F.col("t").isNotNull(), at)).alias("last_event_time"),
        F.max_by("epoch", F.when(of("epoch"), at)).alias("current_epoch"),
    )
    over = F.coalesce(F.col("_end") > F.coalesce("_start", F.lit(-1)), F.lit(False))
    status = F.when(over, F.col("_status")).when(F.col("_start").isNotNull(), "running").otherwise("unknown")
    return ends.withColumn("finished", over).withColumn("status", status).drop("_start", "_end", "_status")


def last_rows(log: DataFrame, run: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each run by order."""
    back = W.partitionBy(run).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")


def eta_seconds(epochs: DataFrame, run: str, order: list[str], epoch: str, seconds: str, total: Column, window: int = 20) -> DataFrame:
    """(run, current, mean_seconds, eta): epochs left times the mean of the last epochs' durations; nulls and zeros count for nothing."""
    recent = last_rows(epochs, run, order, window)
    spent = F.when(F.col(seconds) != 0, F.col(seconds))
    found = recent.groupBy(run).agg(F.max_by(epoch, F.struct(*order)).alias("current"), F.avg(spent).alias("mean_seconds"))
    return found.withColumn("eta", (total - F.col("current") - 1) * F.col("mean_seconds"))


def mean_of_known(values: Column) -> Column:
    """Mean of an array's non-null numbers; null if there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(known) > 0, total / F.size(known))


def first_seen(log: DataFrame, run: str, value: str, pos: str) -> DataFrame:
    """(run, value, first, place): distinct values by their first appearance."""
    first = log.where(F.col(value).isNotNull()).groupBy(run, value).agg(F.min(pos).alias("first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(run).orderBy("first")))


def latest_and_best(series: DataFrame, run: str, value: str, pos: str) -> DataFrame:
    return series.groupBy(run).agg(F.max_by(value, pos).alias("latest"), F.max(value).alias("best"))


def cache_keep(df: DataFrame, owner: str, size: str, order: list[str], cap: float) -> DataFrame:
    """df with `evict`: oldest entries first until what is left fits the cap; the newest always stays."""
    newest = W.partitionBy(owner).orderBy(*[F.desc(c) for c in order])
    kept = F.sum(size).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("evict", (kept > cap) & (F.row_number().over(newest) > 1))


def settled_files(looks: DataFrame, path: str, order: list[str], size: str, changed: str) -> DataFrame:
    """(path, changed, order): the first look at which each version of a file is complete.

    looks: rows of a directory seen again and again. A version (its time of change) is complete when two looks at
    the file that follow each other show it with the same size. Each file's looks are ordered alone.
    """
    w = W.partitionBy(path).orderBy(*order)
    same = (F.lag(size).over(w) == F.col(size)) & (F.lag(changed).over(w) == F.col(changed))
    still = looks.withColumn("_still", same).where("_still")
    return still.groupBy(path, changed).agg(F.min(F.struct(*order)).alias("_at")).select(path, changed, "_at.*")
