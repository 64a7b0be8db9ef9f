"""Packed masks: rows (keys, bx, by, bz, bits), each a brick of 4 x 4 x 4 voxels in the bits of one long.

Bit x + 4y + 16z of a brick is the voxel at that place in it, so sets of voxels meet, part and are counted by
bitwise operators, and a step along an axis is a shift whose overflow goes to the next brick. All
of it stays in generated code, and up to 64 voxels move through a shuffle as one row. Empty bricks have no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BRICK = ["bx", "by", "bz"]
SIDE = 4


def _plane(axis: int, at: int) -> int:
    """The bits of a brick whose place on an axis is `at`, as a signed long."""
    bits = sum(1 << p for p in range(SIDE**3) if p // SIDE**axis % SIDE == at)
    return bits - (1 << 64) if bits >> 63 else bits


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bricks of voxel rows (keys, x, y, z); repeated voxels count once. Places may be negative."""
    brick = [F.shiftright(F.col(c).cast("bigint"), 2).alias(b) for b, c in zip(BRICK, "xyz", strict=True)]
    inside = [F.col(c).cast("int").bitwiseAND(3) for c in "xyz"]
    bit = F.expr("shiftleft(1L, _at)")
    rows = df.select(*keys, *brick, (inside[0] + 4 * inside[1] + 16 * inside[2]).alias("_at"))
    return rows.groupBy(*keys, *BRICK).agg(F.bit_or(bit).alias("bits"))


def unpacked(bricks: DataFrame) -> DataFrame:
    """Voxel rows in place of bricks: the other columns of bricks, and x, y, z."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit(F.col("bits"), p) == 1)
    rest = [c for c in bricks.columns if c not in (*BRICK, "bits")]
    rows = bricks.select(*rest, *BRICK, F.explode(places).alias("_at"))
    place = [(4 * F.col(b) + F.shiftright("_at", 2 * k).bitwiseAND(3)).alias(c) for k, (b, c) in enumerate(zip(BRICK, "xyz", strict=True))]
    return rows.select(*rest, *place)


def volume_bricks(values: np.ndarray, label_column: str = "label") -> pd.DataFrame:
    """(label, bx, by, bz, bits) of a label volume in numpy; 0 is background."""
    shape = [-(-n // SIDE) for n in values.shape]
    whole = np.zeros([n * SIDE for n in shape], values.dtype)
    whole[tuple(slice(n) for n in values.shape)] = values
    cells = whole.reshape(shape[0], SIDE, shape[1], SIDE, shape[2], SIDE).transpose(0, 2, 4, 5, 3, 1).reshape(-1, SIDE**3)
    out = []
    used = np.flatnonzero(cells.any(axis=1))
    for label in np.unique(cells[used]):
        if label:
            found = np.packbits(cells[used] == label, axis=1, bitorder="little").view("<i8").ravel()
            at = np.flatnonzero(found)
            place = np.array(np.unravel_index(used[at], shape), np.int64)
            out.append(pd.DataFrame({label_column: int(label), **dict(zip(BRICK, place, strict=True)), "bits": found[at]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in [label_column, *BRICK, "bits"]})


def places(bx: np.ndarray, by: np.ndarray, bz: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Voxels (rows of x, y, z) of bricks, in numpy."""
    on = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, at = np.nonzero(on)
    return np.stack([SIDE * b[row] + (at >> 2 * k & 3) for k, b in enumerate((bx, by, bz))], axis=1)


def beside(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys, nulls being equal to nulls; the keys are a's."""
    b = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, same, how).drop(*[f"_{k}" for k in keys])


def counts(bricks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) voxels of each mask."""
    return bricks.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n"))


def dice(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, voxels_a, voxels_b, both, dice) of the bricks of two sides; a mask of one side only has dice 0.

    One pass: both sides are stacked, so no join is needed.
    """
    none = F.lit(0).cast("bigint")
    sides = a.select(*keys, *BRICK, F.col("bits").alias("a"), none.alias("b")).unionByName(b.select(*keys, *BRICK, none.alias("a"), F.col("bits").alias("b")))
    both = sides.groupBy(*keys, *BRICK).agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    n = lambda x: F.sum(F.bit_count(x)).cast("bigint")
    out = both.groupBy(*keys).agg(n(F.col("a")).alias("voxels_a"), n(F.col("b")).alias("voxels_b"), n(F.col("a").bitwiseAND(F.col("b"))).alias("both"))
    return out.withColumn("dice", F.try_divide(2 * F.col("both"), F.col("voxels_a") + F.col("voxels_b")))


def surface(bricks: DataFrame, keys: list[str]) -> DataFrame:
    """Bricks of the voxels that lack one of their six face neighbours in the mask; outside the grid is background.

    A brick sends each neighbour the face that they share, so one exchange of at most seven rows a brick does it.
    """
    none, bits = F.lit(0).cast("bigint"), F.col("bits")
    faces = [f"{d}{k}" for k in range(3) for d in ("below", "above")]

    def sent(to: dict[str, int], **what: Column) -> Column:
        brick = [(F.col(b) + to.get(b, 0)).alias(b) for b in BRICK]
        return F.struct(*brick, *[what.get(c, none).alias(c) for c in ["own", *faces]])

    rows = [sent({}, own=bits)]
    for k, b in enumerate(BRICK):
        jump = 3 * SIDE**k
        rows.append(sent({b: 1}, **{f"below{k}": F.shiftrightunsigned(bits.bitwiseAND(_plane(k, SIDE - 1)), jump)}))
        rows.append(sent({b: -1}, **{f"above{k}": F.shiftleft(bits.bitwiseAND(_plane(k, 0)), jump)}))
    some = lambda r: (r["own"] != 0) | (F.greatest(*[F.abs(F.sign(r[f])) for f in faces]) > 0)
    marks = bricks.select(*keys, F.explode(F.filter(F.array(*rows), some)).alias("_r")).select(*keys, "_r.*")
    met = marks.groupBy(*keys, *BRICK).agg(*[F.bit_or(c).alias(c) for c in ["own", *faces]]).where("own != 0")
    own = inner = F.col("own")
    for k in range(3):
        step = SIDE**k
        low = F.shiftleft(own.bitwiseAND(~_plane(k, SIDE - 1)), step).bitwiseOR(F.col(f"below{k}"))
        high = F.shiftrightunsigned(own.bitwiseAND(~_plane(k, 0)), step).bitwiseOR(F.col(f"above{k}"))
        inner = inner.bitwiseAND(low).bitwiseAND(high)
    return met.select(*keys, *BRICK, own.bitwiseAND(F.bitwise_not(inner)).alias("bits")).where("bits != 0")


def merged(claims: DataFrame, case: list[str], policy: str = "smaller_wins") -> DataFrame:
    """(case, label, brick, bits, lost): masks as one label a voxel. `lost` holds the voxels claimed that others got.

    smaller_wins: a contested voxel goes to the structure with fewer voxels, of equal ones to the smaller label;
    label_order: to the largest label. A voxel with n claims is lost n - 1 times, so sums of lost count collisions.
    Within a brick the claims line up by that order, and each gets what none before it holds.
    """
    if policy not in ("smaller_wins", "label_order"):
        raise ValueError(f"unknown overlap policy {policy}")
    rows = claims.groupBy(*case, "label", *BRICK).agg(F.bit_or("bits").alias("bits"))
    order = [F.desc("label")]
    if policy == "smaller_wins":
        sizes = counts(rows, [*case, "label"]).withColumnRenamed("n", "_size")
        rows = beside(rows, sizes, [*case, "label"])
        order = [F.col("_size"), F.col("label")]
    before = W.partitionBy(*case, *BRICK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("bits").over(before), F.lit(0).cast("bigint"))
    own = rows.withColumn("_taken", taken)
    return own.select(
        *case, "label", *BRICK, F.col("bits").bitwiseAND(F.bitwise_not(F.col("_taken"))).alias("bits"), F.col("bits").bitwiseAND(F.col("_taken")).alias("lost")
    )


def remapped(bricks: DataFrame, case: list[str], mapping: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(bricks with labels replaced, report (case, unmapped: array of label and voxels, missing: array of new labels)).

    Voxels of labels that the mapping lacks are dropped and reported with their number, label by label; new
    labels without a voxel in a case are missing there. Several labels may become one. Cases without voxels have no row.
    """
    to = F.create_map(*[F.lit(x).cast("int") for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<int,int>")
    rows = bricks.withColumn("_to", F.try_element_at(to, F.col("label").cast("int")))
    known = rows.where("_to IS NOT NULL").groupBy(*case, F.col("_to").alias("label"), *BRICK).agg(F.bit_or("bits").alias("bits"))
    per = rows.groupBy(*case, "label", "_to").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("_n"))
    wanted = F.array(*[F.lit(x) for x in sorted(set(mapping.values()))]).cast("array<int>")
    unmapped = F.array_sort(F.collect_list(F.when(F.col("_to").isNull(), F.struct("label", F.col("_n").alias("voxels")))))
    report = per.groupBy(*case).agg(unmapped.alias("unmapped"), F.array_sort(F.array_except(wanted, F.collect_set("_to"))).alias("missing"))
    return known, report

