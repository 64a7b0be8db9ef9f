"""Whitening of vectors by exact integer covariances: digit-slice products of matrices.

Entries become integers. Less the whole part of their dimension's mean they are small, and are cut into
balanced limbs of so few bits that sums of products of limbs stay below 2^53: BLAS then
multiplies float64 matrices of limbs without any rounding. The products of all pairs of limbs are put
together as big integers, in digits of 32 bits that Spark adds up across tasks, so the covariance is exact
up to the one division before its eigenvectors are computed. Only counts, sums and the covariance
(whose size is that of a vector, squared) meet the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries beyond this (after scaling) count as this: a long holds no more.
MOST = 2.0**52
#: Bits of a limb, and rows of a product: 2 * 20 + 13 = 53.
BITS, ROWS = 20, 1 << 13
#: Digits of 32 bits in a sum of products: enough for entries of 2^53 and 2^50 rows.
DIGITS = 5


def vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, integer vectors) of the valid rows of a list column: no null, no null entry, all finite, not empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.asarray(column.offsets).astype(np.int64)
    lengths = np.diff(starts)
    good = np.asarray(column.is_valid()) & (lengths > 0)
    values = column.values
    flat = np.asarray(values.cast(pa.float64(), safe=False).fill_null(float("nan")))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good &= bad[starts[1:]] == bad[starts[:-1]]
    rows = np.flatnonzero(good)
    scaled = np.zeros(len(flat), np.int64)
    fine = np.isfinite(flat)
    with np.errstate(over="ignore"):
        scaled[fine] = np.clip(np.floor(flat[fine] * SCALE), -MOST, MOST).astype(np.int64) + SHIFT
    return rows, [scaled[starts[i] : starts[i + 1]] for i in rows]


def of_size(column: pa.ChunkedArray | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the valid vectors of a size."""
    rows, found = vectors(column)
    keep = [k for k, v in enumerate(found) if len(v) == size]
    return rows[keep], np.array([found[k] for k in keep], np.int64).reshape(len(keep), size)


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """Balanced limbs of BITS bits, lowest first, as float64 matrices; z is the sum of limb * 2^(BITS k)."""
    out = []
    while True:
        low = ((z + (1 << BITS - 1)) & ((1 << BITS) - 1)) - (1 << BITS - 1)
        out.append(low.astype(np.float64))
        z = (z - low) >> BITS
        if not z.any():
            return out


def split(total: int) -> list[int]:
    """A big integer in DIGITS digits of 32 bits, the highest with the sign."""
    return [total >> 32 * k & 0xFFFFFFFF for k in range(DIGITS - 1)] + [total >> 32 * (DIGITS - 1)]


def joined(digits: list[int]) -> int:
    return sum(d << 32 * k for k, d in enumerate(digits))


def gram(z: np.ndarray) -> np.ndarray:
    """Exact z'z of an integer matrix, as an object matrix of Python's integers."""
    d = z.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(z), ROWS):
        cut = limbs(z[at : at + ROWS])
        for i, a in enumerate(cut):
            for j, b in enumerate(cut[: i + 1]):
                part = (a.T @ b).astype(np.int64).astype(object)
                total += (part if i == j else part + part.T) << BITS * (i + j)
    return total


def squares(y: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Exact sum of squares of each row of an integer matrix (int64 or object), as Python's integers."""
    if y.dtype == object:
        return (y * y).sum(axis=1)
    cut = limbs(y)
    total = np.zeros(len(y), object)
    step = 1 << 53 - 2 * BITS  # columns that a dot product may add up
    for i, a in enumerate(cut):
        for j, b in enumerate(cut[: i + 1]):
            for at in range(0, y.shape[1], step):
                part = np.einsum("rd,rd->r", a[:, at : at + step], b[:, at : at + step]).astype(np.int64).astype(object)
                total += part * (1 + (i != j)) << BITS * (i + j)
    return total


class Whitening:
    """What the fit list gave: rows n, sums S (integers), eigenvalues e and components (rows of `axes`), share of variance."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray):
        self.n, self.sums = n, sums
        self.floor = [s // n for s in sums]
        rest = np.array([s - n * m for s, m in zip(sums, self.floor, strict=True)], object)
        exact = n * products - np.outer(rest, rest)  # n^2 V: of z = x - floor, whose covariance is x's
        self.rest = np.array([r / n for r in rest], float)
        covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], float)
        e, axes = np.linalg.eigh(covariance)
        order = np.argsort(-e, kind="stable")
        self.e, self.axes = e[order], axes[:, order].T
        self.trace = sum(int(exact[k, k]) for k in range(len(sums))) / (n * n)

    def projected(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows of x whitened: centred, projected, divided by the root of the eigenvalue; NaN where that is not positive."""
        e = self.e[:components]
        scale = np.where(e > len(self.e) * np.finfo(float).eps * max(self.e[0], 0), 1 / np.sqrt(np.where(e > 0, e, 1)), np.nan)
        z = (x - np.array(self.floor, np.int64)).astype(np.float64) - self.rest
        return z @ self.axes[:components].T * scale

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sum over dimensions of (n x - S)^2 of each row."""
        small = self.n * (2 * max(int(np.abs(x).max(initial=0)), max(map(abs, self.floor), default=0)) + 2) < 1 << 62
        kind = np.int64 if small else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        return squares(y)


def _sums(df: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """(size, n, S): the size that most valid vectors have (the smaller of two), how many they are, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            _, found = vectors(batch.column(0))
            for size in {len(v) for v in found}:
                x = np.array([v for v in found if len(v) == size])
                n, high, low = known.get(size, (0, 0, 0))
                known[size] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for size, (n, high, low) in known.items():
            yield pa.RecordBatch.from_pydict(
                {"size": pa.array([size] * size, pa.int32()), "k": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())}
            )

    parts = df.select(F.col(f"`{vector}`")).mapInArrow(run, "size int, k int, n bigint, high bigint, low bigint")
    rows = parts.groupBy("size", "k").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    size = rows.where("k = 0").orderBy(F.desc("n"), "size").limit(1).select("size")
    best = sorted(rows.join(F.broadcast(size), "size").collect(), key=lambda r: r["k"])
    return (best[0]["size"], best[0]["n"], [(r["high"] << 32) + r["low"] for r in best]) if best else (0, 0, [])


def fitted(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all valid vectors of df; None if there are none. Two passes: sums, then products of what is left of the mean."""
    size, n, sums = _sums(df, vector)
    if not n:
        return None
    floor = [s // n for s in sums]
    names = [f"d{k}" for k in range(DIGITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, room = np.zeros((size, size), object), [], 0
        base = np.array(floor, np.int64)
        for batch in batches:
            held.append(of_size(batch.column(0), size)[1] - base)
            room += len(held[-1])
            if room >= ROWS:
                total, held, room = total + gram(np.concatenate(held)), [], 0
        if room:
            total = total + gram(np.concatenate(held))
        for i in range(size):
            cells = [split(int(total[i, j])) for j in range(i + 1)]
            digits = {name: pa.array([c[k] for c in cells], pa.int64()) for k, name in enumerate(names)}
            yield pa.RecordBatch.from_pydict({"i": pa.array([i] * (i + 1), pa.int32()), "j": pa.array(range(i + 1), pa.int32())} | digits)

    parts = df.select(F.col(f"`{vector}`")).mapInArrow(run, f"i int, j int, {', '.join(f'{c} bigint' for c in names)}")
    products = np.zeros((size, size), object)
    for i, j, *digits in parts.groupBy("i", "j").agg(*[F.sum(c) for c in names]).collect():
        products[i, j] = products[j, i] = joined(digits)
    return Whitening(n, sums, products)


def _projected(df: DataFrame, model: Whitening, key: str, vector: str, components: int) -> DataFrame:
    """(key, deviation decimal, whitened array) of each valid vector."""
    size = len(model.sums)
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = of_size(batch.column(1), size)
            found = model.projected(x, components)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            deviations = pa.array([str(v) for v in model.deviations(x)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), deviations, lists], [key, "deviation", "whitened"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).mapInArrow(run, f"{kind}, deviation string, whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the `whitened` arrays minus the identity, over components that have a variance."""
    a = [F.element_at("whitened", k + 1) for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    found = whitened.agg(*[F.covar_pop(a[i], a[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    off = [abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True) if c is not None and c == c]
    return max(off, default=0.0)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation string, whitened, explained, identity_error): a row for each valid vector and component.

    Rows whose vector is null, empty, holds null or non-finite entries, or has another size than most, are left out. Rows
    with equal keys each count; a null key is a key. A component without variance (one vector, equal vectors) has null
    `whitened` and explains 0. `deviation` is written as decimal digits, as a long need not hold it. Other columns
    of df are not read, so their names can clash with nothing.
    """
    model = fitted(df, vector)
    kind = df.schema[key].dataType.simpleString()
    columns = f"`{key}` {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], columns)
    components = min(components, len(model.sums))
    found = _projected(df, model, key, vector, components)
    error = identity_error(found, components)
    share = [float(max(e, 0) / model.trace) if model.trace else 0.0 for e in model.e[:components]]
    rows = found.select(F.col(f"`{key}`"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col(f"`{key}`"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
        F.element_at(F.array(*[F.lit(x) for x in share]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
