import pytest
from pyspark.sql import functions as F

from voxloom.functions import policy
from voxloom.operators import queue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "approved, rejected, streak, since, rate",
    [(4, 0, 4, 4, 1.0), (5, 0, 5, 5, 0.2), (40, 0, 40, 40, 0.1), (9, 1, 0, 0, 1.0), (9, 1, 2, 2, 1.0), (9, 1, 3, 3, 0.2)],
)
def test_review_rate(spark, approved, rejected, streak, since, rate):
    assert one(spark, policy.review_rate(*[F.lit(x) for x in (approved, rejected, streak, since)])) == rate


@pytest.mark.parametrize(
    "roll, submitted, gold, duplicate, kind",
    [
        (0.01, 9, True, True, "gold"),
        (0.07, 9, True, True, "duplicate"),
        (0.5, 9, True, True, "normal"),
        (0.9, 0, True, True, "gold"),
        (0.01, 9, False, True, "duplicate"),
        (0.07, 9, True, False, "normal"),
    ],
)
def test_injection(spark, roll, submitted, gold, duplicate, kind):
    assert one(spark, policy.injection_kind(*[F.lit(x) for x in (roll, submitted, gold, duplicate)])) == kind


def test_rates_over_even_rolls(spark):
    rolls = spark.range(10_000).select((F.col("id") / 10_000).alias("r"))
    kinds = rolls.select(policy.injection_kind(F.col("r"), F.lit(9), F.lit(True), F.lit(True)).alias("k")).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kinds} == {"gold": 500, "duplicate": 500, "normal": 9000}


def test_low_score_forces_review(spark):
    needed = lambda roll, kind, score: one(spark, policy.review_needed(F.lit(roll), F.lit(0.2), F.lit(kind), F.lit(score).cast("double")))
    assert needed(0.9, "gold", 0.69) and not needed(0.9, "gold", 0.7) and not needed(0.9, "gold", None)
    assert needed(0.9, "duplicate", 0.1) and not needed(0.9, "normal", 0.1) and needed(0.1, "normal", None)


def test_lease(spark):
    reason = lambda a, h, now: one(spark, policy.reclaim_reason(F.lit(a), F.lit(h).cast("double"), F.lit(now)))
    day = 86400.0
    assert reason(0.0, None, 6 * day) is None
    assert reason(0.0, None, 7 * day) == "lease of 7 days expired"
    assert reason(0.0, 3600.0, 3600.0 + 4 * day) == "no heartbeat for 72 hours"


@pytest.mark.parametrize("case, status, free", [((1, 0, 0, False), "pending", True), ((1, 1, 0, False), "in_progress", False), ((1, 0, 1, False), "complete", False), ((2, 0, 1, False), "in_progress", True), ((2, 1, 1, False), "in_progress", False), ((1, 0, 0, True), "retired", False)])
def test_status(spark, case, status, free):
    columns = [F.lit(x) for x in case]
    assert one(spark, policy.case_status(*columns)) == status
    assert one(spark, policy.servable(*columns)) is free


def check(spark, counts, seconds=300.0, source=None, made=None):
    m = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    shape = "struct<size:array<int>,spacing:array<double>,origin:array<double>>"
    sides = [None if s is None else F.from_json(F.lit(s), shape) for s in (source, made)]
    found = one(spark, policy.check_submission(m, ["LM", "LAD"], ["RCA"], F.lit(seconds), *sides))
    return [(p["level"], p["code"], p["subject"]) for p in found]


def test_submission_rules(spark):
    good = {"LM": 800, "LAD": 4200, "RCA": 3100}
    assert check(spark, good) == []
    assert check(spark, good | {"LAD": 0}) == [("error", "empty_required_segment", "LAD")]
    assert check(spark, good | {"RCA": 0}) == [("warning", "empty_optional_segment", "RCA")]
    assert check(spark, good | {"LM": 3}) == [("error", "stray_voxels", "LM")]
    assert check(spark, good | {"extra": 500, "nothing": 0}) == [("error", "unexpected_segment", "extra")]
    assert check(spark, good | {"RCA": 0, "LM": 0}, 12.0) == [
        ("error", "empty_required_segment", "LM"),
        ("warning", "empty_optional_segment", "RCA"),
        ("warning", "implausibly_fast", "12"),
    ]
    grid = '{"size":[512,512,300],"spacing":[0.35,0.35,0.4],"origin":[0,0,0]}'
    half = '{"size":[256,256,150],"spacing":[0.7,0.7,0.8],"origin":[0,0,1]}'
    near = '{"size":[512,512,300],"spacing":[0.3500002,0.35,0.4],"origin":[0,0,0]}'
    assert [c for _, c, _ in check(spark, good, 300.0, grid, half)] == ["geometry_size", "geometry_spacing", "geometry_origin"]
    assert check(spark, good, 300.0, grid, near) == []


def test_log_fold_matches_loop(spark):
    import random

    rng = random.Random(3)
    events = [e for _, e, _ in queue.TRANSITIONS] + ["nonsense"]
    log = [(u, i, rng.choice(events)) for i in range(600) for u in [rng.randrange(20)]]
    table = {(s, e): n for s, e, n in queue.TRANSITIONS}
    want = {}
    for u, _, e in log:
        s, a, done, no = want.get(u, ("assigned", 1, 0, 0))
        n = table.get((s, e))
        want[u] = (n or s, a + (n is not None and e == "rework"), done + (n is not None), no + (n is None))
    df = spark.createDataFrame(log, "u int, pos int, event string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in queue.folded_log(df, "u", "event", ["pos"]).collect()} == want


def test_every_state_reaches_an_end():
    reach = {"approved", "released"}
    for _ in range(8):
        reach |= {s for s, _, n in queue.TRANSITIONS if n in reach}
    assert reach == {s for s, _, n in queue.TRANSITIONS for s in (s, n)}


def allocate(spark, requests, cases, taken):
    return queue.allocate(
        spark.createDataFrame(requests, "user bigint, arrived bigint"),
        spark.createDataFrame(cases, "case bigint, priority bigint, created bigint, slots int"),
        spark.createDataFrame(taken, "user bigint, case bigint"),
    ).collect()


def test_thirty_claims_have_thirty_winners(spark):
    won = allocate(spark, [(u, u) for u in range(30)], [(c, 0, c, 1) for c in range(30)], [])
    assert len({r["user"] for r in won}) == len({r["case"] for r in won}) == 30


def test_one_slot_has_one_winner_and_no_repeat(spark):
    assert [(r["user"], r["case"]) for r in allocate(spark, [(1, 5), (2, 4)], [(7, 0, 0, 1)], [])] == [(2, 7)]
    won = allocate(spark, [(1, 1), (2, 2)], [(7, 9, 0, 1), (8, 0, 0, 1)], [(1, 7)])
    assert all((r["user"], r["case"]) != (1, 7) for r in won) and len({r["case"] for r in won}) == len(won)


def one_after_another(requests, cases, taken):
    left, seen, out = {c: s for c, _, _, s in cases}, set(taken), set()
    order = [c for c, *_ in sorted(cases, key=lambda c: (-c[1], c[2], c[0]))]
    for user, _ in sorted(requests, key=lambda r: r[1]):
        for c in order:
            if left[c] > 0 and (user, c) not in seen:
                left[c] -= 1
                seen.add((user, c))
                out.add((user, c))
                break
    return out


@pytest.mark.parametrize("seed, forbid", [(1, 0.0), (2, 0.05), (3, 0.6)])
def test_claims_against_a_plain_loop(spark, seed, forbid):
    """Without forbidden pairs as one after another; with them nobody waits who could be served, and no pair is wrong."""
    import random

    rng = random.Random(seed)
    requests = [(u, rng.randrange(10**6) * 100 + u) for u in range(40)]
    cases = [(c, rng.randrange(4), rng.randrange(5), rng.choice([0, 1, 2])) for c in range(60 if seed < 3 else 25)]
    taken = [(u, c) for u, _ in requests for c, *_ in cases if rng.random() < forbid]
    won = {(r["user"], r["case"]) for r in allocate(spark, requests, cases, taken)}
    want = one_after_another(requests, cases, taken)
    if not forbid:
        assert won == want
    slots = {c: s for c, _, _, s in cases}
    for _, c in won:
        slots[c] -= 1
    served = {u for u, _ in won}
    assert len(served) == len(won) and min(slots.values()) >= 0 and not won & set(taken)
    waiting = {u for u, _ in requests} - served
    assert not any(slots[c] > 0 and (u, c) not in set(taken) for u in waiting for c in slots)


def test_one_who_had_the_first_cases_gets_the_next(spark):
    cases = [(c, 0, c, 1) for c in range(30)]
    assert [r["case"] for r in allocate(spark, [(1, 1)], cases, [(1, c) for c in range(12)])] == [12]


def test_slots_match_a_loop(spark):
    import random

    rng = random.Random(5)
    events = ["claim", "claim", "claim_duplicate", "release", "complete", "retire"]
    log = [(rng.randrange(25), i, rng.choices(events, [6, 6, 6, 3, 3, 1])[0]) for i in range(700)]
    want = {}
    for c, _, e in log:
        wanted, active, approved, retired, refused = want.get(c, (1, 0, 0, False, 0))
        if e == "claim":
            if not retired and active + approved < wanted:
                active += 1
            else:
                refused += 1
        elif e == "claim_duplicate":
            if not retired and (wanted, approved, active) == (1, 1, 0):
                wanted, active = 2, 1
            else:
                refused += 1
        elif e in ("release", "complete"):
            active, approved = max(0, active - 1), approved + (e == "complete")
        else:
            retired = True
        want[c] = (wanted, active, approved, retired, refused)
    df = spark.createDataFrame(log, "c int, pos int, event string").repartition(3)
    assert {r[0]: tuple(r[1:]) for r in queue.slot_counters(df, "c", "event", ["pos"]).collect()} == want


def test_stamps(spark):
    steps = [("assign", 10), ("download", 20), ("approve", 25), ("submit", 30), ("reject", 40), ("rework", 50), ("download", 60)]
    log = spark.createDataFrame([(1, i, e, float(t)) for i, (e, t) in enumerate(steps)], "k int, pos int, event string, at double")
    r = queue.stamped_log(log.where("pos < 5"), "k", "event", "at", ["pos"], lease=100.0).first()
    assert (r["state"], r["attempt"], r["deadline"], r["downloaded_at"], r["submitted_at"], r["decided_at"]) == ("rejected", 1, 110.0, 20.0, 30.0, 40.0)
    r = queue.stamped_log(log, "k", "event", "at", ["pos"], lease=100.0).first()
    assert (r["state"], r["attempt"], r["deadline"], r["downloaded_at"], r["submitted_at"], r["decided_at"], r["reworked_at"]) == ("downloaded", 2, 150.0, 60.0, None, 40.0, 50.0)


def test_first_fitting_verdict_decides(spark):
    asked = [(1, 5, 1, "reject", " "), (1, 6, 2, "approve", None), (1, 7, 3, "reject", "late"), (2, 1, 1, "approve", None), (3, 1, 1, "nonsense", "x")]
    requests = spark.createDataFrame(asked, "k int, at int, reviewer int, verdict string, comment string")
    states = spark.createDataFrame([(1, "submitted"), (2, "assigned"), (3, "submitted")], "k int, state string")
    got = {(r["k"], r["reviewer"]): (r["outcome"], r["event"], r["slot_event"]) for r in queue.judged(requests, states, "k").collect()}
    assert got == {(1, 1): ("comment_required", None, None), (1, 2): ("approved", "approve", "complete"), (1, 3): ("bad_state", None, None), (2, 1): ("bad_state", None, None), (3, 1): ("bad_state", None, None)}


def test_one_of_equal_verdicts_decides(spark):
    asked = [(1, 5, 2, "approve", "x"), (1, 5, 2, "approve", "x"), (1, 5, 2, "reject", "x"), (2, 5, 1, "reject", "x"), (2, 5, 1, "reject", "x"), (2, 5, 1, "reject", None)]
    requests = spark.createDataFrame(asked, "k int, at int, reviewer int, verdict string, comment string")
    states = spark.createDataFrame([(1, "submitted"), (2, "submitted")], "k int, state string")
    got = sorted((r["k"], r["verdict"], r["outcome"], r["slot_event"] or "") for r in queue.judged(requests, states, "k").collect())
    late = [(1, "approve", "approved", "complete"), (1, "approve", "bad_state", ""), (1, "reject", "bad_state", "")]
    assert got == [*late, (2, "reject", "bad_state", ""), (2, "reject", "comment_required", ""), (2, "reject", "rejected", "")]


def test_segments_are_checked(spark):
    schema = "name string, label int"
    found = lambda rows: {tuple(r) for r in policy.segment_problems(spark.createDataFrame(rows, schema)).collect()}
    assert found([("a", 1), ("b", 2)]) == set() and found([]) == {("no_segments", "")}
    assert found([("a", 1), ("a", 3), ("b", 0), ("c", 3)]) == {("duplicate_name", "a"), ("duplicate_label", "3"), ("background_label", "b")}


def test_replica_names(spark):
    rows = spark.createDataFrame([("c", 3), ("c", 1), ("d", 2)], "case string, t int")
    assert {r["replica_name"] for r in queue.replica_names(rows, "case", F.col("case"), ["t"]).collect()} == {"c", "c__r2", "d"}


def test_policy_is_checked():
    with pytest.raises(ValueError):
        policy.SamplingPolicy(gold_rate=0.7, duplicate_rate=0.4).checked()
    with pytest.raises(ValueError):
        policy.SamplingPolicy(lease_days=0).checked()
    assert policy.SamplingPolicy().checked()


def test_failed_scores_stand_in_nobodys_way(spark):
    """25 rows at the head can never be scored; the 26th is, and in the end they are set aside."""
    work = [(k, k, "gold") for k in range(30)] + [(99, 0, "normal")]
    df = spark.createDataFrame(work, "key int, submitted int, kind string")
    tries, now, seen = [], 0.0, []
    for _ in range(2):
        batch = [r["key"] for r in queue.next_scores(df, spark.createDataFrame(tries, "key int, at double, ok boolean"), F.lit(now)).collect()]
        tries += [(k, now, k >= 25) for k in batch]
        seen.append(batch)
        now += 30
    assert seen == [list(range(25)), [25, 26, 27, 28, 29]]
    tries += [(k, 1000.0 * i, False) for i in range(1, queue.GIVE_UP) for k in range(25)]
    log = spark.createDataFrame(tries, "key int, at double, ok boolean")
    assert {r["status"] for r in queue.due_scores(df, log, F.lit(1e9)).collect()} == {"dead"}
    assert queue.next_scores(df, log, F.lit(1e9)).count() == 0


def test_waits_double(spark):
    df = spark.createDataFrame([(1, 1, "gold")], "key int, submitted int, kind string")
    for n, wait in ((1, 60), (2, 120), (3, 240)):
        log = spark.createDataFrame([(1, 100.0 * i, False) for i in range(n)], "key int, at double, ok boolean")
        last = 100.0 * (n - 1)
        assert [queue.due_scores(df, log, F.lit(last + wait + d)).first()["status"] for d in (-1.0, 0.0)] == ["waiting", "due"]


def test_named_users_get_cases(spark):
    cases = spark.createDataFrame([(1, 1, 0, 0, False), (2, 2, 0, 0, False), (3, 1, 1, 0, False), (4, 1, 0, 0, True)], "case int, wanted int, active int, approved int, retired boolean")
    orders = spark.createDataFrame([(7, 1), (8, 1), (7, 1), (7, 2), (8, 2), (9, 2), (7, 3), (7, 4), (7, 5)], "user int, case int")
    met = spark.createDataFrame([(7, 2), (7, 3)], "user int, case int")
    got = {(r["user"], r["case"]): r["outcome"] for r in queue.assigned(orders, cases, met).collect()}
    assert got == {
        (7, 1): "assigned", (8, 1): "not_servable", (7, 2): "had_it", (8, 2): "assigned", (9, 2): "assigned", (7, 3): "not_servable", (7, 4): "not_servable", (7, 5): "unknown_case",
    }


def test_a_long_past_makes_few_tries(spark, monkeypatch):
    """One user had all but the last of 40 cases, another all of them; each looks at four cases a round."""
    monkeypatch.setattr(queue, "TRIES", 4)
    cases = [(c, 100 - c, 0, 1) for c in range(40)]
    taken = [(1, c) for c in range(39)] + [(2, c) for c in range(40)]
    won = allocate(spark, [(1, 1), (2, 2), (3, 3)], cases, taken)
    got = {r["user"]: r["case"] for r in won}
    assert got[1] == 39 and 2 not in got and set(got) == {1, 3}


def test_union_of_labels_and_images_expands_nothing(spark, sf):
    from voxloom.plans import annotation_queries

    plan = annotation_queries.cte_union_all(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Union" not in plan and "collect_set" not in plan


def test_kept_rows_are_computed_once(spark):
    from voxloom.session import kept

    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(len(b))
            yield b

    assert kept(spark.range(10).mapInPandas(counted, "id bigint")).count() == 10 and met.value == 10
