import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import log_fold, queue
from voxloom.sources.snapshots import Conflict, Snapshots, Version, ingested

EVENTS = ["assign", *queue.STAMPS, "abandon_review", "nonsense", None]


def logs(seed, users, n):
    rng = random.Random(seed)
    return [(rng.randrange(users), i, rng.choice(EVENTS), float(i * 10)) for i in range(n)]


def expected(rows):
    by = {}
    for u, _, e, t in rows:
        by.setdefault(u, []).append((e, t))
    return {u: log_fold.loop(queue.ASSIGNMENT, r) for u, r in by.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "u int, pos int, event string, t double").repartition(5)


def parts(df):
    return log_fold.stretches(df, "u", "event", ["pos"], queue.ASSIGNMENT, "t")


def collected(df):
    return {r["u"]: {k: v for k, v in r.asDict().items() if k != "u"} for r in df.collect()}


@pytest.mark.parametrize("users, n", [(1, 3000), (40, 3000), (700, 900)])
def test_fold_equals_the_loop(spark, users, n):
    rows = logs(users, users, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)  # many stretches a log
    try:
        assert collected(log_fold.folded(parts(frame(spark, rows)), "u", queue.ASSIGNMENT)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("cut", [0, 1, 700, 1499, 1500])
def test_snapshot_and_delta_equal_the_whole_log(spark, cut):
    rows = logs(7, 30, 1500)
    early = log_fold.folded(parts(frame(spark, rows).where(f"pos < {cut}")), "u", queue.ASSIGNMENT)
    late = log_fold.folded(parts(frame(spark, rows).where(f"pos >= {cut}")), "u", queue.ASSIGNMENT, early)
    assert collected(late) == expected(rows)


def test_one_long_log_spreads_over_tasks(spark):
    n = 200_000
    names = F.array(*[F.lit(e) for e in EVENTS[:-1]])
    log = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("pos"), F.element_at(names, (F.pmod(F.xxhash64("id"), F.lit(len(EVENTS) - 1)) + 1).cast("int")).alias("event"), F.col("id").cast("double").alias("t"))
    found = parts(log)
    assert found.select("_part").distinct().count() > 4
    rows = [(r["event"], r["t"]) for r in log.orderBy("pos").collect()]
    assert collected(log_fold.folded(found, "u", queue.ASSIGNMENT)) == {1: log_fold.loop(queue.ASSIGNMENT, rows)}


def test_edges(spark):
    rows = [(None, 1, "download", 1.0), (None, 2, "submit", 2.0), (3, 1, None, None)]
    assert collected(log_fold.folded(parts(frame(spark, rows)), "u", queue.ASSIGNMENT)) == expected(rows)
    assert collected(log_fold.folded(parts(frame(spark, [])), "u", queue.ASSIGNMENT)) == {}


@pytest.mark.parametrize("wanted", [1, 2, 3])
def test_slots_equal_plain_counters(spark, wanted):
    rng = random.Random(wanted)
    rows = [(rng.randrange(60), i, rng.choice(["claim", "claim", "claim_duplicate", "release", "complete", "retire" if rng.random() < 0.2 else "claim", "x"]), 0.0) for i in range(2000)]
    want = {}
    for u, _, e, _ in rows:
        w, a, p, r, no = want.get(u, (wanted, 0, 0, False, 0))
        if e == "claim" and not r and a + p < w:
            a += 1
        elif e == "claim_duplicate" and not r and (w, a, p) == (1, 0, 1):
            w, a = 2, a + 1
        elif e in ("claim", "claim_duplicate"):
            no += 1
        elif e == "release":
            a = max(0, a - 1)
        elif e == "complete":
            a, p = max(0, a - 1), p + 1
        elif e == "retire":
            r = True
        want[u] = (w, a, p, r, no)
    got = queue.slot_counters(frame(spark, rows), "u", "event", ["pos"], wanted)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_snapshots_of_a_log(spark, tmp_path):
    rows = logs(9, 12, 400)
    state = Snapshots(spark, str(tmp_path / "s"))

    def apply(delta):
        def change(now):
            return {"states": log_fold.folded(parts(delta), "u", queue.ASSIGNMENT, state.read("states", now))}, {}

        return change

    for number, low in enumerate(range(0, 400, 100)):
        delta = frame(spark, rows).where(f"pos >= {low} AND pos < {low + 100}")
        for _ in range(2):  # a batch that comes again changes nothing
            assert state.update(apply(delta), "log", number).number == number + 1
    assert collected(state.read("states")) == expected(rows)
    assert state.expire(keep=1) == 3 and collected(state.read("states")) == expected(rows)


def test_two_writers_one_wins(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "s"))
    assert state.read("t") is None
    first = state.commit({"t": spark.range(1)}, Version(0))
    state.commit({"t": spark.range(2)}, first)
    with pytest.raises(Conflict):
        state.commit({"t": spark.range(3)}, first)
    assert state.read("t").count() == 2 and state.version().number == 2
    seen = []

    def late(now):
        seen.append(now.number)
        if len(seen) == 1:  # another writer is faster, once
            state.commit({}, now, appended={"t": spark.range(5)})
        return {"t": spark.range(10 * now.number)}, {}

    assert state.update(late).number == 4 and seen == [2, 3] and state.read("t").count() == 30
    assert not [f for f in (tmp_path / "s" / "commits").iterdir() if f.suffix == ".part"]


def test_appends_and_compaction(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "s"))
    for k in range(4):
        state.update(lambda now, k=k: ({}, {"t": spark.range(k)}), "a", k)
    assert state.read("t").count() == 6 and len(state.version().tables["t"]) == 4
    state.compacted("t", most=3)
    assert state.read("t").count() == 6 and len(state.version().tables["t"]) == 1 and state.version().batches == {"a": 3}


def test_ingest_by_name(spark, tmp_path):
    state = Snapshots(spark, str(tmp_path / "s"))
    make = lambda rows: spark.createDataFrame(rows, "name string, size int")
    batches = [[("a", 1), ("b", 2), ("a", 0), (None, 5)], [("b", 9), ("c", 3)], []]
    for k, rows in [*enumerate(batches), (1, batches[1])]:
        state.update(lambda now, rows=rows: ({"cases": ingested(state.read("cases", now), make(rows), "name")}, {}), "ingest", k)
    assert sorted(map(tuple, state.read("cases").collect())) == [("a", 0), ("b", 2), ("c", 3)]


def test_heartbeats_append_and_move_nothing(spark, tmp_path):
    from voxloom.streaming import beats

    state = Snapshots(spark, str(tmp_path / "s"))
    state.commit({"states": spark.createDataFrame([(1, "assigned"), (2, "approved"), (3, "rejected")], "assignment bigint, state string")}, Version(0))
    assert beats.heard(state).collect() == []
    rows = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 9.0), (4, 9.0)], beats.BEATS)
    for _ in range(2):
        beats.beaten(state, rows, "client", 0)
    beats.beaten(state, spark.createDataFrame([(3, 7.0), (1, 4.0)], beats.BEATS), "client", 1)
    assert state.read("beats").count() == 3
    assert {tuple(r) for r in beats.heard(state).collect()} == {(1, 5.0), (3, 7.0)}
    assert {tuple(r) for r in state.read("states").collect()} == {(1, "assigned"), (2, "approved"), (3, "rejected")}
