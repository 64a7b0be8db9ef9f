"""Folds of logs by a finite automaton, in parts: a stretch of a log is a map from the state before it to what it does.

What a stretch does, from each state it could begin in: the state it ends in, what it adds to counters, and for each
stamped column whether it was set (to the last time), cleared, or left alone. Such maps compose, so a log of any
length is cut wherever tasks happen to cut it, every stretch is reduced to one row, and the few rows of a
key are composed in order. The same rows turn a snapshot of earlier states into one of later states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a log that are composed at once; more of one key make more stretches.
BLOCK = 1 << 16
SET, CLEARED = 1, 2


@dataclass
class Automaton:
    """states: names, the first one that of a key without a past. events: names; an event of another name is the last column.

    after[s, e]: the state that follows; adds[name][s, e]: what a counter gains; marks[name][s, e]: SET if the stamped
    column takes the event's time, CLEARED if it is emptied, else 0.
    """

    states: list[str]
    events: list[str]
    after: np.ndarray
    adds: dict[str, np.ndarray] = field(default_factory=dict)
    marks: dict[str, np.ndarray] = field(default_factory=dict)

    def schema(self) -> str:
        arrays = "".join(f", {c} array<bigint>" for c in self.adds) + "".join(f", {c}_mark array<tinyint>, {c} array<double>" for c in self.marks)
        return f"_part int, _block bigint, _after array<smallint>{arrays}"

    def composed(self, keys: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Starts of the runs of equal keys, and for each run what it does: arrays of runs x states."""
        n, states = len(codes), len(self.states)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        place = np.arange(n) - starts[run]
        # prefixes by doubling: after step d, row i holds the map of the last 2d events up to i
        prefix = np.ascontiguousarray(self.after.T[codes]).astype(np.int16)
        longest, d = int(place.max(initial=0)) + 1, 1
        while d < longest:
            late = np.flatnonzero(place >= d)
            prefix[late] = np.take_along_axis(prefix[late], prefix[late - d], axis=1)
            d *= 2
        before = np.empty_like(prefix)
        before[1:] = prefix[:-1]
        before[starts] = np.arange(states)
        ends = np.append(starts[1:], n) - 1
        out = {"_after": prefix[ends]}
        for name, table in self.adds.items():
            out[name] = np.add.reduceat(table[before, codes[:, None]].astype(np.int64), starts, axis=0)
        for name, table in self.marks.items():
            marked = table[before, codes[:, None]]
            last = np.maximum.reduceat(np.where(marked > 0, np.arange(n)[:, None], -1), starts, axis=0)
            found = np.where(last >= 0, np.take_along_axis(marked, np.maximum(last, 0), axis=0), 0)
            out[f"{name}_mark"] = found
            out[name] = np.where(found == SET, times[np.maximum(last, 0)], np.nan)
        return starts, out


def stretches(log: DataFrame, key: str, event: str, order: list[str], automaton: Automaton, at: str | None = None) -> DataFrame:
    """(key, _part, _block, maps): one row for each stretch of a key's log that lies in one block of one task.

    The log is dealt by ranges of (key, order), so a long log spreads over tasks, and equal keys and orders meet.
    """
    codes = F.create_map(*[F.lit(x) for i, e in enumerate(automaton.events) for x in (e, i)])
    code = F.coalesce(F.try_element_at(codes, F.col(event)), F.lit(len(automaton.events)))
    time = F.col(at).cast("double") if at else F.lit(None).cast("double")
    rows = log.select(F.col(key), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], code.alias("_code"), time.alias("_time"))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *[f"_o{i}" for i in range(len(order))]]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(key, "_code", "_time")
    kind = dealt.schema[key].dataType.simpleString()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(low, BLOCK)
                numbers = np.asarray(rows.column(0).dictionary_encode(null_encoding="encode").indices)
                starts, maps = automaton.composed(numbers, rows.column(1).to_numpy(zero_copy_only=False), rows.column(2).to_numpy(zero_copy_only=False))
                arrays = [rows.column(0).take(pa.array(starts)), pa.array([part] * len(starts), pa.int32()), pa.array([block] * len(starts), pa.int64())]
                for name, table in maps.items():
                    flat = pa.array(table.ravel(), from_pandas=table.dtype.kind == "f")
                    flat = flat.cast({"_after": pa.int16()}.get(name, pa.int8() if name.endswith("_mark") else flat.type))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * table.shape[1], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(arrays, [key, "_part", "_block", *maps])
                block += 1

    return dealt.mapInArrow(compose, f"`{key}` {kind}, {automaton.schema()}")


def begun(automaton: Automaton, start: int = 0) -> Column:
    """What a key without a past has: the state numbered `start`, counters at 0, empty stamps."""
    none = F.lit(None).cast("double")
    return F.struct(F.lit(start).alias("state"), *[F.lit(0).cast("bigint").alias(c) for c in automaton.adds], *[none.alias(c) for c in automaton.marks])


def folded(parts: DataFrame, key: str, automaton: Automaton, snapshot: DataFrame | None = None, start: int = 0) -> DataFrame:
    """(key, state number, counters, stamps) of each key after its stretches, from its row in `snapshot`, which has the same columns.

    Keys of the snapshot without a stretch stay as they are. A null key is a key.
    """
    maps = [c for c in parts.columns if c != key]
    lined = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*maps))).alias("_maps"))

    def step(s: Column, m: Column) -> Column:
        own = lambda c: F.element_at(m[c], s["state"] + 1)
        stamp = lambda c: F.when(own(f"{c}_mark") == 0, s[c]).otherwise(own(c))
        return F.struct(
            own("_after").cast("int").alias("state"), *[(s[c] + own(c)).alias(c) for c in automaton.adds], *[stamp(c).alias(c) for c in automaton.marks]
        )

    fresh = begun(automaton, start)
    if snapshot is None:
        return lined.select(key, F.aggregate("_maps", fresh, step).alias("_s")).select(key, "_s.*")
    columns = ["state", *automaton.adds, *automaton.marks]
    kinds = ["int"] + ["bigint"] * len(automaton.adds) + ["double"] * len(automaton.marks)
    old = snapshot.select(F.col(key).alias("_key"), F.struct(*[F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)]).alias("_old"))
    both = lined.withColumn("_new", F.lit(True)).join(old, F.col(key).eqNullSafe(F.col("_key")), "full")
    state = F.aggregate(F.coalesce("_maps", F.array().cast(dict(lined.dtypes)["_maps"])), F.coalesce("_old", fresh), step)
    return both.select(F.when(F.col("_new"), F.col(key)).otherwise(F.col("_key")).alias(key), state.alias("_s")).select(key, "_s.*")


def loop(automaton: Automaton, rows: list[tuple[str, float | None]], state: int = 0) -> dict:
    """One log folded by a plain loop over (event, time)."""
    out = {"state": state} | dict.fromkeys(automaton.adds, 0) | dict.fromkeys(automaton.marks)
    for event, time in rows:
        e, s = automaton.events.index(event) if event in automaton.events else len(automaton.events), out["state"]
        for c, table in automaton.adds.items():
            out[c] += int(table[s, e])
        for c, table in automaton.marks.items():
            if table[s, e]:
                out[c] = time if table[s, e] == SET else None
        out["state"] = int(automaton.after[s, e])
    return out


def tabled(states: list, events: list[str], step: Callable, adds: Iterable[str] = (), marks: Iterable[str] = ()) -> Automaton:
    """The automaton of a function step(state, event) -> (next state, {counter: gain}, {stamp: SET or CLEARED}); it also gets the event None, any other."""
    shape = (len(states), len(events) + 1)
    found = Automaton(states, events, np.zeros(shape, np.int16), {c: np.zeros(shape, np.int64) for c in adds}, {c: np.zeros(shape, np.int8) for c in marks})
    for i, s in enumerate(states):
        for j, e in enumerate([*events, None]):
            to, gains, set_ = step(s, e)
            found.after[i, j] = states.index(to)
            for c, v in gains.items():
                found.adds[c][i, j] = v
            for c, v in set_.items():
                found.marks[c][i, j] = v
    return found


def named(df: DataFrame, automaton: Automaton) -> DataFrame:
    """df with the state's name in place of its number."""
    return df.withColumn("state", F.element_at(F.array(*[F.lit(s) for s in automaton.states]), F.col("state") + 1))


def numbered(df: DataFrame, automaton: Automaton) -> DataFrame:
    """df with the state's number in place of its name."""
    return df.withColumn("state", (F.array_position(F.array(*[F.lit(s) for s in automaton.states]), F.col("state")) - 1).cast("int"))

