"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform permutation of N rows sends, from a cell of n rows, a multivariate hypergeometric
number of rows to each shard. Drawing that matrix first, one cell after another from what
the shards still have free, fixes all counts exactly; then rows are permuted within their
cell, cut at the drawn counts, exchanged, and permuted again within their shard. Only cell
sizes and the matrix (cells x shards integers, both bounded by parameters) meet the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good."""
    if not (good and sample):
        return 0
    if not bad:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    # beyond numpy's range: inverse transform outwards from the mode
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = up = down = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left, i, j = rng.random() - at, mode, mode
    while left > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (sample - i) / ((i + 1) * (bad - sample + i + 1))
            i, left = i + 1, left - up
            if left <= 0:
                return i
        if j > low:
            down *= j * (bad - sample + j) / ((good - j + 1) * (sample - j + 1))
            j, left = j - 1, left - down
            if left <= 0:
                return j
    return mode


def communication_matrix(cell_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """counts[cell, shard] of a uniform permutation; rows sum to the cells' sizes, columns to the shards'."""
    rng, free = np.random.default_rng(seed), [int(x) for x in shard_sizes]
    out = np.zeros((len(cell_sizes), len(shard_sizes)), dtype=np.int64)
    for i, n in enumerate(cell_sizes):
        rest = sum(free)
        for s, room in enumerate(free):
            rest -= room
            out[i, s] = took = hypergeometric(rng, room, rest, n)
            free[s] -= took
            n -= took
            if not n:
                break
    return out


def uniform_shards(
    df: DataFrame, keys: list[str] | None = None, shards: int = 24, seed: int = 20, cells: int = 4096, parts: int = 64
) -> DataFrame:
    """df with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most, and every assignment of rows to slots is equally
    likely under the seed. `keys` (default: doc_id) name the rows; equal seeds and keys give
    equal results, whatever the partitions. `cells` bounds the local permutations and the
    matrix, `parts` (a power of two) those within a shard. Null keys count as a key of their
    own, rows with equal keys take neighbouring ranks in any order, an empty df gives no
    rows; columns of df named shard or slot are replaced.
    """
    keys = keys or ["doc_id"]
    bits = int(math.log2(parts))
    at = lambda k: F.xxhash64(F.lit(seed + k), *[F.col(f"`{c}`") for c in keys])
    cell: Column = F.pmod(at(0), F.lit(cells)).cast("int")
    dealt = df.drop("shard", "slot").withColumn("_cell", cell)

    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_cell").count().collect())
    total = sum(n for _, n in sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = np.cumsum(communication_matrix([n for _, n in sizes], room, seed), axis=1)
    matrix = df.sparkSession.createDataFrame(
        [(c, [int(x) for x in row]) for (c, _), row in zip(sizes, cuts, strict=True)], "_cell int, _cuts array<bigint>"
    )

    first = W.partitionBy("_cell").orderBy(at(1), *keys)
    second = W.partitionBy("shard", "_part").orderBy("_again", *keys)
    sent = (
        dealt.withColumn("_rank", F.row_number().over(first) - 1)
        .join(F.broadcast(matrix), "_cell")
        .withColumn("shard", F.size(F.filter("_cuts", lambda x: x <= F.col("_rank"))))
        .withColumn("_again", at(2))
        .withColumn("_part", F.shiftrightunsigned("_again", 64 - bits) if bits else F.lit(0).cast("bigint"))
    )
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sent.groupBy("shard", "_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ).drop("count")
    return (
        sent.join(F.broadcast(starts), ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.row_number().over(second) - 1).cast("bigint"))
        .drop("_cell", "_rank", "_cuts", "_again", "_part", "_start")
    )
