"""Label volumes as sparse rows (case, label, x, y, z): overlap, surfaces, scores, merging; geometry and paired tests.

Voxel rows are packed into bricks (operators/bricks.py) before anything is exchanged, and surface distances are made
plane by plane and column by column (operators/distances.py), so neither a case nor a structure is one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.operators import bricks, distances

XYZ = ["x", "y", "z"]


def dice(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, label, voxels_a, voxels_b, both, dice) of voxel rows; a structure of one side only has dice 0."""
    by = [*keys, label]
    return bricks.dice(bricks.packed(a, by), bricks.packed(b, by), by)


def surface(df: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels of each (keys) mask with fewer than six face neighbours in it; outside the grid is background."""
    return bricks.unpacked(bricks.surface(bricks.packed(df, keys), keys))


def nearest(points: np.ndarray, others: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Exact distance of each point to the closest of the others, by slabs along the first axis: for points off any grid (on one, see operators/distances.py)."""
    others = others[np.argsort(others[:, 0], kind="stable")]
    order = np.argsort(points[:, 0], kind="stable")
    out = np.empty(len(points))
    for i in range(0, len(points), chunk):
        idx = order[i : i + chunk]
        part = points[idx]
        low = high = int(np.searchsorted(others[:, 0], part[len(part) // 2, 0]))
        best = np.full(len(part), np.inf)
        while low > 0 or high < len(others):
            a, b = max(0, low - chunk), min(len(others), high + chunk)
            for s, e in ((a, low), (high, b)):
                if s < e:
                    best = np.minimum(best, ((part[:, None, :] - others[None, s:e]) ** 2).sum(axis=2).min(axis=1))
            low, high = a, b
            reach = np.inf
            if low > 0:
                reach = min(reach, part[0, 0] - others[low - 1, 0])
            if high < len(others):
                reach = min(reach, others[high, 0] - part[-1, 0])
            if reach > 0 and reach * reach > best.max():
                break
        out[idx] = np.sqrt(best)
    return out


def score_cases(
    pred: DataFrame,
    ref: DataFrame,
    keys: list[str],
    spacing: tuple[float, float, float],
    tolerance: float = 1.5,
    surfaces: bool = True,
    only: list | None = None,
    labels: list[int] | None = None,
    cases: DataFrame | None = None,
) -> DataFrame:
    """Dice and, unless surfaces is False, NSD and HD95 of every structure (`only` some labels) of every case.

    pred and ref are voxel rows (keys, label, x, y, z) or bricks (keys, label, bx, by, bz, bits).
    With `labels`, every case (of `cases`, else of either side) has a row for each of them: a structure that
    neither side holds has no voxels and null scores.
    """
    if only is not None:
        pred, ref = (side.where(F.col("label").isin(only)) for side in (pred, ref))
    by = [*keys, "label"]
    pred, ref = (side.select(*by, *bricks.BRICK, "bits") if "bits" in side.columns else bricks.packed(side, by) for side in (pred, ref))
    found = bricks.dice(pred, ref, by)
    if surfaces:
        scores = distances.surface_scores(bricks.surface(pred, by), bricks.surface(ref, by), by, spacing, tolerance)
        found = bricks.beside(found, scores.drop("n"), by, "left")
    if labels is not None:
        wanted = [x for x in labels if only is None or x in only]
        every = (cases.select(*keys) if cases is not None else pred.select(*keys).unionByName(ref.select(*keys))).distinct()
        every = every.select(*keys, F.explode(F.array(*[F.lit(x) for x in wanted])).alias("label"))
        found = every.join(found, by, "left").na.fill(0, ["voxels_a", "voxels_b", "both"])
    return found


def case_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_dice, mean_nsd, n_present, n_classes) of score rows; means over known scores, null if there are none."""
    return scores.groupBy(*keys).agg(
        F.avg("dice").alias("mean_dice"), F.avg("nsd").alias("mean_nsd"), F.count_if(F.col("voxels_b") > 0).alias("n_present"), F.count("*").alias("n_classes")
    )


def structure_report(scores: DataFrame, name: str = "label", few: int = 5) -> DataFrame:
    """(name, dice, nsd, n_cases_present, n_cases, rare, place): structures from the lowest mean dice on, unknown ones last, ties by name.

    There are as many rows as structures, so one window orders them.
    """
    per = scores.groupBy(name).agg(
        F.avg("dice").alias("dice"), F.avg("nsd").alias("nsd"), F.count_if(F.col("voxels_b") > 0).alias("n_cases_present"), F.count("*").alias("n_cases")
    )
    place = F.row_number().over(W.orderBy(F.col("dice").asc_nulls_last(), name))
    return per.withColumn("rare", F.col("n_cases_present") < few).withColumn("place", place)


def shape_mismatches(pred: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """(key, pred_size, ref_size) of cases whose volumes (key, size) differ in shape: these cannot be scored."""
    both = pred.select(key, F.col("size").alias("pred_size")).join(ref.select(key, F.col("size").alias("ref_size")), key)
    return both.where("pred_size != ref_size")


def corrected_masks(masks: DataFrame, volumes: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """masks (key, ...) with `affine` and `corrected`: that of their case's volume (key, affine: 12 numbers), made orthonormal where it is not.

    Spacing and origin stay; directions within the tolerance stay as they are. A degenerate volume has a null affine.
    """
    m = F.array(*[F.get("affine", F.lit(4 * r + c)).cast("double") for r in range(3) for c in range(3)])
    oblique = volumes.select(key, "affine", m.alias("_m")).withColumn("corrected", direction_error(F.col("_m")) > tolerance)
    fixed = oblique.withColumn("_fixed", orthonormalised(F.col("_m")))
    merged = F.array(*[F.get("_fixed", F.lit(3 * r + c)) if c < 3 else F.get("affine", F.lit(4 * r + 3)).cast("double") for r in range(3) for c in range(4)])
    plain = F.transform("affine", lambda x: x.cast("double"))
    done = fixed.select(key, F.when(F.col("corrected"), F.when(F.col("_fixed").isNotNull(), merged)).otherwise(plain).alias("affine"), "corrected")
    return masks.drop("affine", "corrected").join(done, key)


def masks_of(df: DataFrame, case: str, labels: list[int]) -> DataFrame:
    """(case, label, voxels): one mask per case and structure as an array of places, empty ones kept, other labels left out.

    A mask is bounded by its volume. Places are in order.
    """
    of = df.where(F.col("label").isin(labels)).groupBy(case, "label").agg(F.array_sort(F.collect_set(F.struct(*XYZ))).alias("voxels"))
    every = df.select(case).distinct().select(case, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    kind = dict(of.dtypes)["voxels"]
    return every.join(of, [case, "label"], "left").withColumn("voxels", F.coalesce("voxels", F.array().cast(kind)))


def merge_masks(claims: DataFrame, case: list[str], policy: str = "smaller_wins") -> tuple[DataFrame, DataFrame]:
    """Masks (case, label, x, y, z) as one label per voxel, and (case, collisions).

    smaller_wins: a contested voxel goes to the structure with fewer voxels, of equal ones to the
    smaller label; label_order: to the largest label. A voxel with n claims counts n - 1 collisions.
    """
    found = bricks.merged(bricks.packed(claims, [*case, "label"]), case, policy)
    collisions = found.groupBy(*case).agg(F.sum(F.bit_count("lost")).cast("bigint").alias("collisions"))
    return bricks.unpacked(found.drop("lost")), collisions


def label_counts(df: DataFrame, case: str, labels: list[int]) -> DataFrame:
    """(case, label, n) for every case and label of the set, zero where none; labels outside the set are left out."""
    counts = df.groupBy(case, "label").agg(F.count("*").alias("n"))
    every = df.select(case).distinct().select(case, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return every.join(counts, [case, "label"], "left").select(case, "label", F.coalesce("n", F.lit(0)).alias("n"))


def direction_error(m: Column) -> Column:
    """Largest deviation of D'D from the identity, D being a 3x3 matrix (row-major array) with unit columns; infinite for a zero column."""
    v = lambda r, c: F.get(m, F.lit(3 * r + c)).cast("double")
    dot = lambda a, b: sum(v(r, a) * v(r, b) for r in range(3))
    norm = [F.sqrt(dot(c, c)) for c in range(3)]
    off = [F.abs(F.try_divide(dot(a, b), norm[a] * norm[b]) - (1.0 if a == b else 0.0)) for a in range(3) for b in range(a, 3)]
    return F.when(F.least(*norm) > 0, F.greatest(*off)).otherwise(F.lit(float("inf")))


def affine_offset(a: Column, b: Column, shape: tuple[int, int, int]) -> Column:
    """Largest distance (mm) between two affines (12 numbers, row-major 3x4) at the corners of a volume."""
    at = lambda m, r, c: F.get(m, F.lit(4 * r + c)).cast("double")
    corners = [(x, y, z, 1) for x in (0, shape[0] - 1) for y in (0, shape[1] - 1) for z in (0, shape[2] - 1)]
    gap = lambda p, r: sum((at(a, r, c) - at(b, r, c)) * p[c] for c in range(4))
    return F.greatest(*[F.sqrt(sum(gap(p, r) * gap(p, r) for r in range(3))) for p in corners])


def orthonormalised(m: Column) -> Column:
    """The nearest matrix with orthonormal directions and the same spacing (row-major 3x3 arrays); null for a zero column."""

    @F.pandas_udf("array<double>")
    def polar(rows: pd.Series) -> pd.Series:
        a = np.stack([np.asarray(x, float)[:9].reshape(3, 3) for x in rows]) if len(rows) else np.empty((0, 3, 3))
        spacing = np.linalg.norm(a, axis=1)
        sound = (spacing > 0).all(axis=1)
        unit = a / np.where(spacing > 0, spacing, 1)[:, None, :]
        u, _, v = np.linalg.svd(unit)
        fixed = (u @ v) * spacing[:, None, :]
        return pd.Series([list(x.ravel()) if ok else None for x, ok in zip(fixed, sound, strict=True)])

    return polar(m)


def signed_rank_chance(n: int, w: float, ties: float, exact: bool) -> float:
    """Two-sided chance of a signed-rank statistic of w or less among n unequal pairs.

    exact: counted over all signs (no ties); else the normal approximation, whose variance is less by ties
    (the sum of t^3 - t over ties of t pairs, over 48).
    """
    if exact:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread > 0 else 1.0


def signed_rank(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, w, p): Wilcoxon statistic of pairs, the smaller rank sum, and its two-sided chance; null below six pairs or if all are equal.

    Pairs with a null or NaN are dropped, equal ones get no rank; ties share their mean rank. The chance is
    exact for at most 50 pairs, all unequal and without ties, else approximate.
    Differences are counted first, so a group's window holds distinct differences only.
    """
    x, y = F.nanvl(F.col(a), F.lit(None)), F.nanvl(F.col(b), F.lit(None))
    pairs = df.select(*by, (x - y).alias("_d")).where("_d IS NOT NULL")
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    tied = pairs.where("_d != 0").groupBy(*by, F.abs("_d").alias("_m")).agg(F.count("*").alias("_k"), F.count_if(F.col("_d") > 0).alias("_up"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*by).orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("_rank", before + (F.col("_k") + 1) / 2)
    k = F.col("_k").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("_rank") * F.col("_up")).alias("_p"), F.sum(F.col("_rank") * (F.col("_k") - F.col("_up"))).alias("_q"), F.sum("_k").alias("_used"), (F.sum(k * k * k - k) / 48).alias("_ties")
    )

    @F.pandas_udf("double")
    def chance(used: pd.Series, w: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_chance(int(u), x, t, e) if x == x and x is not None else None for u, x, t, e in zip(used, w, ties, exact, strict=True)], dtype="float64")

    found = n.join(sums, by, "left").withColumn("w", F.when(F.col("n") >= 6, F.least("_p", "_q")))
    exact = (F.col("n") <= 50) & (F.col("_used") == F.col("n")) & (F.col("_ties") == 0)
    given = [F.coalesce("_used", F.lit(0)), F.col("w"), F.coalesce("_ties", F.lit(0.0)), F.coalesce(exact, F.lit(False))]
    return found.select(*by, "n", "w", F.when(F.col("w").isNotNull(), chance(*given)).alias("p"))
