"""Packing documents into sequences of a fixed capacity by linear grouping.

Lengths are integers up to the capacity, so a histogram, of as many rows as the capacity at most, holds all
that a plan needs. Large lengths are sorted down and cut into groups of equal cardinality, each rounded up to its
largest member; for these few sizes the fractional packing by configurations (which sizes share a
sequence, and how often) is solved by column generation. Whole multiples of configurations are opened and their slots
filled with actual documents; what is left, with all small documents, is put best-fit into the gaps, longest first.

A plan speaks of ranges: the k-th to l-th document of a length go to consecutive sequences at one offset. Each
document gets a rank among those of its length from counts of tasks and lengths, so neither a length nor
a sequence is ever gathered in one place to be numbered.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import words
from voxloom.llm.store import trimmed, written

#: A length over this share of the capacity is large; groups that large lengths are rounded to; steps of the simplex at most.
LARGE, GROUPS, STEPS = 1 / 6, 64, 2000


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, and how often each size is in it."""
    most = capacity // int(sizes.min())
    layers, chosen = [np.zeros(capacity + 1)], []
    for _ in range(most):
        before, after, choice = layers[-1], layers[-1].copy(), np.full(capacity + 1, -1)
        for j in np.flatnonzero(worth > 0):
            s = sizes[j]
            value = before[: capacity + 1 - s] + worth[j]
            better = value > after[s:] + 1e-12
            after[s:][better], choice[s:][better] = value[better], j
        layers.append(after)
        chosen.append(choice)
    used, room = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(chosen):
        j = choice[room]
        if j >= 0:
            used[j] += 1
            room -= int(sizes[j])
    return float(layers[-1][capacity]), used


def fractional_packing(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(configuration, multiplicity) of a packing of fewest sequences when these may be cut, by the simplex method with columns made when needed."""
    n = len(sizes)
    basis, cost = np.diag(capacity // sizes).astype(float), np.ones(n)
    level = demand / np.diag(basis)
    for _ in range(STEPS):
        worth = np.linalg.solve(basis.T, cost)
        if worth.min() < -1e-9:  # more of a size than asked for is no fault
            column, price = np.zeros(n), 0.0
            column[worth.argmin()] = -1
        else:
            value, used = best_configuration(sizes, worth, capacity)
            if value <= 1 + 1e-7:
                break
            column, price = used.astype(float), 1.0
        change = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(change > 1e-9, level / change, np.inf)
        out = int(steps.argmin())
        level = np.maximum(level - steps[out] * change, 0)
        level[out], basis[:, out], cost[out] = steps[out], column, price
    return [(basis[:, k].astype(np.int64), float(level[k])) for k in range(n) if cost[k] and level[k] > 1e-9]


@dataclass
class Plan:
    """Ranges of documents: `count` of a length from rank `first` on, one to each sequence from `sequence` on, at `offset`. Sorted by length and rank."""

    length: np.ndarray
    first: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of documents by length and rank among those of that length."""
        at = np.searchsorted(self.length * (1 << 50) + self.first, length * (1 << 50) + rank, "right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


class _Packer:
    """Sequences as runs of equally filled ones, by gap; documents as counts by length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(histogram)
        self.given: Counter = Counter()
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.room = np.zeros(capacity + 1, np.int64)
        self.sequences = 0

    def opened(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def put(self, gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            self.gaps[gap].append(run)
            self.room[gap] += run[1]

    def place(self, length: int, gap: int, run: tuple[int, int], count: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """Documents of a length into the first `count` of a run of sequences with a gap; the filled part and the rest."""
        self.rows.append((length, self.given[length], count, run[0], self.capacity - gap))
        self.given[length] += count
        self.left[length] -= count
        return (run[0], count), (run[0] + count, run[1] - count)

    def best_fit(self, length: int) -> None:
        """All documents left of a length, each into the smallest gap that takes it, or into a new sequence."""
        while self.left[length] > 0:
            fits = np.flatnonzero(self.room[length:])
            if len(fits):
                gap = length + int(fits[0])
                run = self.gaps[gap].pop()
                self.room[gap] -= run[1]
            else:
                each = self.capacity // length
                gap, run = self.capacity, self.opened(max(1, self.left[length] // each))
                while gap - length >= length and self.left[length] >= 2 * run[1]:
                    run, _ = self.place(length, gap, run, run[1])
                    gap -= length
            full, rest = self.place(length, gap, run, min(run[1], self.left[length]))
            self.put(gap - length, full)
            self.put(gap, rest)

    def configured(self, large: list[int], groups: int) -> None:
        """Opens whole multiples of the configurations of grouped large lengths (longest first), and fills their slots."""
        total = sum(self.left[x] for x in large)
        each = -(-total // groups) if len(large) > groups else 1  # few lengths are groups as they are
        demand: Counter = Counter()
        before = size = at = 0
        for x in large:
            todo = self.left[x]
            if len(large) <= groups:
                demand[x] = todo
                continue
            while todo:
                if before == at:  # a group begins: its size is that of its longest
                    size, at = x, at + each
                took = min(todo, at - before)
                demand[size] += took
                todo, before = todo - took, before + took
        self.long = np.zeros(self.capacity + 1, np.int64)
        self.long[large] = [self.left[x] for x in large]
        sizes = np.array(sorted(demand, reverse=True))
        for used, times in fractional_packing(sizes, np.array([demand[s] for s in sizes], float), self.capacity):
            if times >= 1 - 1e-9:
                self._filled(np.repeat(sizes, used).tolist(), int(times + 1e-9))

    def _filled(self, slots: list[int], times: int) -> None:
        """New sequences with an actual document in each slot: the longest left that the slot takes, in the last slot the longest that the gap takes.

        Slots of a size take all shorter documents, so taking the longest never keeps another slot empty; what it
        changes is only by how much the last document fills the gap that rounding has left.
        """
        parts = [(self.opened(times), self.capacity)]
        for k, size in enumerate(slots):
            after = []
            for run, gap in parts:
                most = gap if k == len(slots) - 1 else size
                while run[1] and len(fits := np.flatnonzero(self.long[: most + 1])):
                    length = int(fits[-1])
                    full, run = self.place(length, gap, run, min(run[1], int(self.long[length])))
                    self.long[length] -= full[1]
                    after.append((full, gap - length))
                if run[1]:
                    after.append((run, gap))
            parts = after
        for run, gap in parts:
            self.put(gap, run)


def planned(histogram: dict[int, int], capacity: int = 4096, groups: int = GROUPS) -> Plan:
    """Where documents of each length (1 to capacity) go: histogram holds how many there are of each."""
    pack = _Packer({x: n for x, n in histogram.items() if n > 0}, capacity)
    lengths = sorted(pack.left, reverse=True)
    large = [x for x in lengths if LARGE * capacity < x < capacity]
    if large:
        pack.configured(large, groups)
    for x in lengths:
        pack.best_fit(x)
    rows = np.array(sorted(pack.rows), np.int64).reshape(-1, 5)
    return Plan(*rows.T, pack.sequences - int(pack.room[capacity]))


def cut(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, nth[, ids]): a row for each piece of each document, kept in the shared folder.

    A document is its text's ids and the id `end`; longer ones than the capacity are cut. A null text counts as empty, a
    null key is a key, repeated rows each count. nth numbers a task's (part's) pieces of one length from 0. With `ids`
    the pieces' ids come along, as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[key].dataType.simpleString()
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, part = words.loaded(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for i, found in enumerate(t.encode(batch.column(1).to_pylist())):
                raw = found.tobytes() + last
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) >> 2
                    rows.append((i, k, at >> 2, n, zlib.crc32(own), part, seen[n], own if ids else None))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:7], KINDS, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[7], pa.binary())] * ids, [key, *NAMES] + ["ids"] * ids)
        t.clear()
        trimmed()

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * ids
    return written(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema))


NAMES = ["piece", "start", "length", "ids_crc32", "part", "nth"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces of cut() with sequence_id and offset in place of part and nth. No pieces give no rows.

    The plan is made on the driver from one row a length, and holds ranges, not documents.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(planned(histogram, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def where(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            sequence, offset = plan.value.places(length.to_numpy(), rank.to_numpy())
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(firsts, ["part", "length"]).withColumn("_place", where("length", F.col("nth") + F.col("_first")))
    return ranked.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_place.*")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces that carry their ids: each at most a capacity long."""
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return rows.select("sequence_id", "length", F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "").alias("ids")).withColumn("ids", F.unhex("ids"))
