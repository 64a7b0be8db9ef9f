"""Exact Euclidean distances between surfaces, by a separable transform along x, y and z.

The squared distance to a set is a minimum over each axis in turn: of the squared steps along x, then of parabolas along
y, then along z. A line's minimum is the lower envelope of its parabolas, found in one run over the line, all lines of
a plane at once. Spark deals the planes of x and y first (a slab of them to a group), then columns along z (a square
tile of them to a group), so no task ever holds a volume, and work grows with the planes and tiles a
structure reaches, not with pairs of voxels.

Where both surfaces of a structure are small (their voxels make at most PAIRS pairs), planes would hold far more than the
surfaces do: such a structure is one group, and all its pairs are measured. Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.operators.bricks import BRICK, SIDE, beside, places
from voxloom.session import kept

#: Bricks along z in a slab, and along x and y in a tile.
SLAB, TILE = 4, 8
WIDE = TILE * SIDE
#: Places of planes whose envelopes are found at once, at most (or one plane).
CELLS = 1 << 20
#: Lines of so many places need no envelope.
SHORT = 128
#: Pairs of voxels of both surfaces up to which a structure is measured pair by pair.
PAIRS = 1 << 20
#: Pairs that are held at once.
HELD = 1 << 18


def steps_along(marks: np.ndarray) -> np.ndarray:
    """Steps to the nearest mark of each place of each line (row): what the envelope is where all heights are 0. Infinite in lines without one."""
    n = marks.shape[1]
    i = np.arange(n, dtype=float)
    left = np.maximum.accumulate(np.where(marks, i, -np.inf), axis=1)
    right = np.minimum.accumulate(np.where(marks, i, np.inf)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(i - left, right - i)


def envelope(heights: np.ndarray, step: float) -> np.ndarray:
    """min over j of heights[:, j] + (step (i - j))^2 for every line (row) and place i; infinite heights have no parabola.

    Felzenszwalb and Huttenlocher's lower envelope: a line's stack of parabolas and where each begins to be the lowest.
    Tables lie with the lines side by side, as each step is taken in all lines at once.
    """
    m, n = heights.shape
    w = step * step
    if n <= SHORT:  # as fast one parabola after another
        out, i = np.full((m, n), np.inf), np.arange(n)
        for j in np.flatnonzero(np.isfinite(heights).any(axis=0)):
            np.minimum(out, heights[:, j, None] + w * (i - j) ** 2, out=out)
        return out
    over_w = np.ascontiguousarray(heights.T) / w
    stack, begins = np.zeros((n, m), np.int32), np.full((n + 1, m), np.inf)
    top = np.full(m, -1)
    finite = np.isfinite(over_w)
    for q in range(n):
        todo = np.flatnonzero(finite[q])
        while len(todo):
            k = top[todo]
            at = np.maximum(k, 0)
            v = stack[at, todo]
            with np.errstate(invalid="ignore", divide="ignore"):
                cross = (over_w[q, todo] - over_w[v, todo] + (q * q - v * v)) / (2.0 * (q - v))
            first = k < 0
            cross[first] = -np.inf
            over = (cross <= begins[at, todo]) & ~first  # the last parabola is nowhere lowest
            if over.any():
                put, cross = todo[~over], cross[~over]
                top[todo[over]] -= 1
                todo = todo[over]
            else:
                put, todo = todo, todo[:0]
            top[put] += 1
            stack[top[put], put], begins[top[put], put] = q, cross
            begins[top[put] + 1, put] = np.inf
    out = np.full((n, m), np.inf)
    some = np.flatnonzero(top >= 0)
    last, at = top[some], np.zeros(len(some), np.int64)
    for i in range(n):
        todo = np.flatnonzero((at < last) & (begins[np.minimum(at + 1, n), some] < i))
        while len(todo):
            at[todo] += 1
            todo = todo[(at[todo] < last[todo]) & (begins[np.minimum(at[todo] + 1, n), some[todo]] < i)]
        v = stack[at, some]
        out[i, some] = (over_w[v, some] + (i - v) ** 2) * w
    return out.T


def plane_distances(points: np.ndarray, low: tuple[int, int], size: tuple[int, int], spacing: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(z, squared distances): for each plane that holds some of the points, mm to the nearest of them at each place (x, y) of a window from `low` on.

    Points outside the window count: along an axis they only move the window's ends.
    """
    start = np.minimum(points[:, :2].min(axis=0), low)
    end = np.maximum(points[:, :2].max(axis=0) + 1, np.add(low, size))
    x0, y0 = (low - start).tolist()
    wide, high = (end - start).tolist()
    z, plane = np.unique(points[:, 2], return_inverse=True)
    lines, line = np.unique(plane * high + points[:, 1] - start[1], return_inverse=True)  # only lines along x that hold points
    marks = np.zeros((len(lines), wide), bool)
    marks[line, points[:, 0] - start[0]] = True
    along_x = (spacing[0] * steps_along(marks)[:, x0 : x0 + size[0]]) ** 2
    heights = np.full((len(z), high, size[0]), np.inf)
    heights[lines // high, lines % high] = along_x
    columns = heights.transpose(0, 2, 1).reshape(-1, high)
    return z, envelope(columns, spacing[1])[:, y0 : y0 + size[1]].reshape(len(z), size[0], size[1])


def distances(of: DataFrame, to: DataFrame, keys: list[str], spacing: tuple[float, float, float]) -> DataFrame:
    """(keys, d, n): n voxels of a mask of `of` are d mm from the nearest voxel of the mask of `to` with the same keys.

    Both are bricks. Masks that one side lacks have no rows; a distance may have several, one a tile.
    """
    tile = [F.floor(F.col(b) / TILE).cast("bigint").alias(t) for b, t in zip(BRICK[:2], ("tx", "ty"), strict=True)]
    kind = ", ".join(f"`{k}` {of.schema[k].dataType.simpleString()}" for k in keys)
    asked = of.select(*keys, *BRICK, "bits", *tile)
    slabs = to.select(*keys, *BRICK, "bits", F.floor(F.col("bz") / SLAB).cast("bigint").alias("_slab"))

    def planes(rows: pa.Table, tiles: pa.Table) -> pa.Table:
        if not len(rows) or not len(tiles):
            return flat_schema.empty_table()
        found = tiles["_tiles"].combine_chunks().flatten()
        wanted = np.stack([found.field("tx").to_numpy(), found.field("ty").to_numpy()], axis=1)
        low = wanted.min(axis=0) * WIDE
        size = tuple(((wanted.max(axis=0) + 1) * WIDE - low).tolist())
        points = places(*[rows[c].to_numpy() for c in (*BRICK, "bits")])
        out = []
        at_once = max(1, CELLS // int(np.prod(np.maximum(size, np.ptp(points[:, :2], axis=0) + 1))))
        levels = np.unique(points[:, 2])
        for k in range(0, len(levels), at_once):
            some = points[np.isin(points[:, 2], levels[k : k + at_once])]
            for z, found in zip(*plane_distances(some, low, size, spacing[:2]), strict=True):
                for tx, ty in wanted.tolist():
                    x, y = tx * WIDE - low[0], ty * WIDE - low[1]
                    out.append((tx, ty, int(z), found[x : x + WIDE, y : y + WIDE].tobytes()))
        return with_keys(rows, flat_schema, list(zip(*out, strict=True)))

    def columns(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not len(rows) or not len(found):
            return count_schema.empty_table()
        points = places(*[rows[c].to_numpy() for c in (*BRICK, "bits")])
        corner = rows["tx"][0].as_py() * WIDE, rows["ty"][0].as_py() * WIDE
        z = found["z"].to_numpy()
        start, end = min(z.min(), points[:, 2].min()), max(z.max(), points[:, 2].max()) + 1
        used, line = np.unique((points[:, 0] - corner[0]) * WIDE + points[:, 1] - corner[1], return_inverse=True)
        heights = np.full((len(used), end - start), np.inf)
        heights[:, z - start] = np.frombuffer(b"".join(found["d2"].to_pylist())).reshape(len(z), -1)[:, used].T
        d, n = np.unique(np.sqrt(envelope(heights, spacing[2])[line, points[:, 2] - start]), return_counts=True)
        return with_keys(rows, count_schema, [d, n])

    fields = [pa.field(k, to_arrow_type(of.schema[k].dataType)) for k in keys]
    flat_schema = pa.schema([*fields, ("tx", pa.int64()), ("ty", pa.int64()), ("z", pa.int64()), ("d2", pa.binary())])
    count_schema = pa.schema([*fields, ("d", pa.float64()), ("n", pa.int64())])

    def with_keys(rows: pa.Table, schema: pa.Schema, cols: list) -> pa.Table:
        """Columns after the keys, which are those of the group's first row."""
        first = pa.array(np.zeros(len(cols[0]), np.int64))
        made = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[len(keys) :], strict=True)]
        return pa.Table.from_arrays([*[rows[k].combine_chunks().take(first).cast(schema.field(k).type) for k in keys], *made], schema=schema)

    # a slab takes along the tiles that are asked for in its mask: both are few, a plane's and a height's worth
    slab, tiles = F.col("_slab"), F.struct("tx", "ty")
    none = F.lit(None).cast("struct<tx:bigint,ty:bigint>")
    marks = asked.select(*keys, tiles.alias("_tile"), F.lit(None).cast("bigint").alias("_slab")).unionByName(slabs.select(*keys, none.alias("_tile"), slab))
    known = marks.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.collect_set("_tile").alias("_tiles"), F.collect_set("_slab").alias("_slabs"))
    dealt = known.withColumn("_of_slab", F.explode("_slabs")).drop("_slabs").where(F.size("_tiles") > 0)
    right = dealt.groupBy(*[f"_of_{k}" for k in keys], "_of_slab")
    flat = slabs.groupBy(*keys, "_slab").cogroup(right).applyInArrow(planes, f"{kind}, tx bigint, ty bigint, z bigint, d2 binary")
    return asked.groupBy(*keys, "tx", "ty").cogroup(flat.groupBy(*keys, "tx", "ty")).applyInArrow(columns, f"{kind}, d double, n bigint")


def nearest(points: np.ndarray, others: np.ndarray, spacing: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """mm from each of the points to the nearest of the others, and from each of those to the nearest of the points."""
    there, back = np.full(len(points), np.inf), np.full(len(others), np.inf)
    step = max(1, HELD // max(1, len(others)))
    for i in range(0, len(points), step):
        d2 = sum((s * (points[i : i + step, None, k] - others[:, k])) ** 2 for k, s in enumerate(spacing))
        there[i : i + step] = d2.min(axis=1, initial=np.inf)
        np.minimum(back, d2.min(axis=0), out=back)
    return np.sqrt(there), np.sqrt(back)


def pair_distances(both: DataFrame, keys: list[str], spacing: tuple[float, float, float]) -> DataFrame:
    """(keys, _side, d, n) of small surfaces (keys, _side, bricks): a group holds both sides of one."""
    kind = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)
    schema = pa.schema([*[pa.field(k, to_arrow_type(both.schema[k].dataType)) for k in keys], ("_side", pa.int32()), ("d", pa.float64()), ("n", pa.int64())])

    def measured(rows: pa.Table) -> pa.Table:
        side = rows["_side"].to_numpy()
        cols = [rows[c].to_numpy() for c in (*BRICK, "bits")]
        found = nearest(*[places(*[c[side == k] for c in cols]) for k in (0, 1)], spacing)
        d, n = zip(*[np.unique(f, return_counts=True) for f in found], strict=True)
        sides, d, n = np.repeat(np.array([0, 1], np.int32), [len(d[0]), len(d[1])]), np.concatenate(d), np.concatenate(n)
        first = pa.array(np.zeros(len(d), np.int64))
        same = [rows[k].combine_chunks().take(first).cast(schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, pa.array(sides), pa.array(d), pa.array(n, pa.int64())], schema=schema)

    return both.groupBy(*keys).applyInArrow(measured, f"{kind}, _side int, d double, n bigint")


def surface_scores(a: DataFrame, b: DataFrame, keys: list[str], spacing: tuple[float, float, float], tolerance: float = 1.5) -> DataFrame:
    """(keys, n, nsd, hd95) from the surface bricks of both sides.

    n: voxels of both surfaces; nsd: share of them within the tolerance (mm); hd95: the larger of the two 95th
    percentiles (linear) of surface distances. A structure on one side only has nsd 0 and infinite hd95.
    """
    # both ways in one pass, over surfaces that are made once
    both = kept(a.select(*keys, *BRICK, "bits", F.lit(0).alias("_side")).unionByName(b.select(*keys, *BRICK, "bits", F.lit(1).alias("_side"))))
    voxels = [F.coalesce(F.sum(F.when(F.col("_side") == k, F.bit_count("bits"))), F.lit(0)).cast("bigint").alias(f"_n{k}") for k in (0, 1)]
    sizes = kept(both.groupBy(*keys).agg(*voxels))
    paired = sizes.where("_n0 > 0 AND _n1 > 0").select(*keys, (F.col("_n0").cast("double") * F.col("_n1") <= PAIRS).alias("_small"))
    small, large = (beside(both, paired.where(c).drop("_small"), keys) for c in ("_small", "NOT _small"))
    found = pair_distances(small, keys, spacing)
    if not paired.where("NOT _small").isEmpty():
        planes = distances(large, large.withColumn("_side", 1 - F.col("_side")), [*keys, "_side"], spacing)
        found = found.unionByName(planes)
    # every structure counts once more without a distance, so that those of one side have a row
    none = sizes.select(*keys, F.lit(None).cast("int").alias("_side"), F.lit(None).cast("double").alias("d"), F.lit(0).cast("bigint").alias("n"), (F.col("_n0") + F.col("_n1")).alias("_all"))
    rows = found.withColumn("_all", F.lit(0).cast("bigint")).unionByName(none)
    far = [F.percentile(F.when(F.col("_side") == k, F.col("d")), 0.95, F.col("n")) for k in (0, 1)]
    near = F.sum(F.when(F.col("d") <= tolerance, F.col("n")).otherwise(0))
    scored = rows.groupBy(*keys).agg(F.sum("_all").alias("_all"), near.alias("_near"), F.sum("n").alias("_n"), far[0].alias("_far0"), far[1].alias("_far1"))
    return scored.select(
        *keys, F.col("_all").alias("n"), F.coalesce(F.try_divide("_near", "_n"), F.lit(0.0)).alias("nsd"), F.coalesce(F.greatest("_far0", "_far1"), F.lit(float("inf"))).alias("hd95")
    )


def transform(points: np.ndarray, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> np.ndarray:
    """The whole transform of one small volume in numpy: distance (mm) of each voxel to the nearest of the points."""
    d2 = np.full(shape, np.inf)
    z, found = plane_distances(points, (0, 0), shape[:2], spacing[:2])
    d2[:, :, z] = found.transpose(1, 2, 0)
    return np.sqrt(envelope(d2.reshape(-1, shape[2]), spacing[2]).reshape(shape))
