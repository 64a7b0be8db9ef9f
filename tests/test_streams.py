import datetime
import random
import time

import pytest

from voxloom.functions.policy import SamplingPolicy
from voxloom.streaming import claims, late_scores, lease_timers

REQUEST = "request bigint, user bigint, arrived bigint, roll double, submitted int, open int, quota_left int"


def case(k, gold=False, wanted=1, active=0, approved=0, retired=False, priority=0):
    return (k, priority, k, gold, wanted, active, approved, retired)


def asked(request, user, roll=0.9, submitted=9, open_=0, quota=None):
    return (request, user, request, roll, submitted, open_, quota)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(live, spark, folder, checkpoint):
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(folder))
    live.start(stream, str(checkpoint), availableNow=True).awaitTermination()


def outcomes(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "state" / "outcomes" / "claims"))


def opened(spark, tmp_path, cases, past=None):
    return claims.LiveClaims.opened(spark, str(tmp_path / "state"), spark.createDataFrame(cases, claims.CASES), past)


def test_thirty_claims_thirty_winners_across_restarts(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path / "in", [asked(10 * k + i, 10 * k + i) for i in range(10)], REQUEST)
        # each time another query and another view of the state, which is opened again and kept
        live = claims.LiveClaims(opened(spark, tmp_path, [case(c) for c in range(30)]))
        run(live, spark, tmp_path / "in", tmp_path / "check")
    found = outcomes(spark, tmp_path).collect()
    assert len(found) == 30 and all(r["outcome"] == "served" for r in found)
    assert len({r["case"] for r in found}) == 30 and len({r["request"] for r in found}) == 30
    assert live.state.read("claims").count() == 30


def test_a_batch_that_comes_again_serves_nobody_twice(spark, tmp_path):
    live = claims.LiveClaims(opened(spark, tmp_path, [case(1), case(2)]))
    batch = spark.createDataFrame([asked(1, 5)], REQUEST)
    for _ in range(2):
        live.batch(batch, 0)
    assert [tuple(r)[:3] for r in live.state.read("claims").collect()] == [(1, 5, 1)]
    live.batch(spark.createDataFrame([asked(2, 5)], REQUEST), 1)
    live.closed(spark.createDataFrame([(5, 1, "complete")], "user bigint, case bigint, event string"), 0)
    live.closed(spark.createDataFrame([(5, 1, "complete")], "user bigint, case bigint, event string"), 0)
    live.batch(spark.createDataFrame([asked(3, 5), asked(4, 5), asked(5, 6)], REQUEST), 2)
    got = {r["request"]: (r["outcome"], r["case"]) for r in outcomes(spark, tmp_path).collect()}
    # 2: the first case is still open; 3: another case than before; 4: the same user again; 5: the first is done, nothing is left
    assert got == {1: ("served", 1), 2: ("at_limit", None), 3: ("served", 2), 4: ("at_limit", None), 5: ("queue_empty", None)}


def test_pools(spark, tmp_path):
    cases = [case(1, gold=True), case(2), case(3, approved=1), case(4, retired=True), case(5, wanted=2, active=1), case(6, approved=1)]
    past = spark.createDataFrame([(7, 3)], "user bigint, case bigint")
    live = claims.LiveClaims(opened(spark, tmp_path, cases, past))
    rows = [asked(1, 1, roll=0.01), asked(2, 2, roll=0.01), asked(3, 7, roll=0.07), asked(4, 8, roll=0.07, quota=0), asked(5, 9, roll=0.9, submitted=0), asked(6, 10, roll=0.5), asked(7, 11, open_=1)]
    live.batch(spark.createDataFrame(rows, REQUEST), 0)
    got = {r["request"]: (r["outcome"], r["case"], r["kind"]) for r in outcomes(spark, tmp_path).collect()}
    assert got[1] == ("served", 1, "gold")
    assert got[2] == ("served", 2, "normal")  # the one gold case went to who came first
    assert got[3] == ("served", 6, "duplicate")  # case 3 was this user's own
    assert got[4][0] == "quota" and got[7][0] == "at_limit"
    assert got[5] == ("served", 5, "normal") and got[6] == ("queue_empty", None, None)  # a gold case is never given as ordinary work
    now = {r["case"]: r for r in claims.current_cases(live.state.read("cases"), live.state.read("claims"), live.state.read("closings")).collect()}
    assert (now[6]["wanted"], now[6]["active"], now[1]["active"], now[5]["active"]) == (2, 1, 1, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_batches_never_break_a_rule(spark, tmp_path, seed):
    rng = random.Random(seed)
    live = claims.LiveClaims(opened(spark, tmp_path, [case(c, gold=c % 5 == 0, wanted=rng.choice([1, 1, 2]), priority=rng.randrange(3)) for c in range(12)]))
    for k in range(3):
        rows = [asked(100 * k + i, rng.randrange(8), roll=rng.random()) for i in range(6)]
        live.batch(spark.createDataFrame(rows, REQUEST), k)
    log = live.state.read("claims").collect()
    assert len({(r["user"], r["case"]) for r in log}) == len(log) == len({r["user"] for r in log})
    now = claims.current_cases(live.state.read("cases"), live.state.read("claims"), live.state.read("closings")).collect()
    assert all(r["active"] + r["approved"] <= r["wanted"] for r in now)


def streams(spark, tmp_path, name, rows, schema, split):
    """A stream of rows in files of at most `split` rows, in order."""
    for i in range(0, len(rows), split):
        put(spark, tmp_path / name, rows[i : i + split], schema)
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


@pytest.mark.parametrize("split", [3, 50])
def test_late_scores_for_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    at = lambda m: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)
    work = sorted([(k, at(rng.randrange(5000)), rng.choice(["gold", "duplicate", "normal"]), rng.random() < 0.2) for k in range(18)], key=lambda r: r[1])
    late = sorted([(k, s + datetime.timedelta(minutes=rng.randrange(-20, 400)), rng.random()) for k, s, *_ in work for _ in range(rng.randrange(3))], key=lambda r: r[1])
    want = {}
    for k, s, kind, flag in work:
        mine = [v for j, t, v in late if j == k and s <= t <= s + datetime.timedelta(hours=5)]
        want[k] = (flag or any(kind != "normal" and v < 0.7 for v in mine), len(mine))
    end = at(10**6)  # moves both watermarks past everything
    subs = streams(spark, tmp_path, "subs", [*work, (-1, end, "normal", False)], "key int, submitted timestamp, kind string, flagged boolean", split)
    found = streams(spark, tmp_path, "scores", [*late, (-2, end, 0.0)], "key int, scored timestamp, score double", split)
    out = late_scores.scored_stream(subs, found, "5 hours", "60 days")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).where("key >= 0").collect():
        flag, n = got.get(r["key"], (False, 0))
        got[r["key"]] = (flag or r["needs_review"], n + (r["score"] is not None))
    assert got == want


def test_a_silent_lease_expires(spark, tmp_path):
    """No event comes after the first file, yet the clock ends three leases; a snapshot's lease is one of them."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    lease_timers.stored(spark)
    try:
        now = datetime.datetime.now(datetime.UTC)
        ago = lambda **k: now - datetime.timedelta(**k)
        rows = [
            (1, ago(days=6, hours=23, minutes=59, seconds=52), "assign"),  # ends in 8 seconds
            (2, ago(days=1), "assign"),
            (3, ago(days=30), "assign"),
            (3, ago(days=29), "submit"),
            (4, ago(days=5), "assign"),
            (4, ago(days=4), "heartbeat"),  # silent for too long already
            (5, ago(days=20), "heartbeat"),  # without a lease
            (7, ago(seconds=1), "heartbeat"),  # renews the snapshot's silence
        ]
        put(spark, tmp_path / "log", rows, "assignment bigint, ts timestamp, event string")
        past = [(6, ago(days=6, hours=23, minutes=59, seconds=50).timestamp(), None), (7, ago(days=1).timestamp(), ago(days=2).timestamp())]
        snapshot = spark.createDataFrame(past, "assignment bigint, assigned double, heard double")
        log = spark.readStream.schema("assignment bigint, ts timestamp, event string").parquet(str(tmp_path / "log"))
        out = lease_timers.silent_expiries(log, SamplingPolicy(), snapshot)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
        try:
            deadline, got = time.time() + 90, []
            while time.time() < deadline and len(got) < 3 and q.isActive:
                time.sleep(2)
                got = spark.read.schema(lease_timers.OUT).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        finally:
            q.stop()
        assert q.exception() is None
        assert {(r["assignment"], r["reason"]) for r in got} == {(1, "lease of 7 days expired"), (4, "no heartbeat for 72 hours"), (6, "lease of 7 days expired")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

