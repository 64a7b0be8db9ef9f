"""The annotation work-queue over append-only logs: states, records, burn-down, allocation, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.policy import DUPLICATE, GOLD, NORMAL, blocking, review_needed
from voxloom.operators.log_fold import CLEARED, SET, Automaton, folded, named, stretches, tabled
from voxloom.operators.ranks import placed
from voxloom.session import kept

# Legal transitions (state, event, next state) of an assignment.
TRANSITIONS = [
    ("assigned", "download", "downloaded"),
    ("assigned", "release", "released"),
    ("assigned", "expire", "released"),
    ("downloaded", "submit", "submitted"),
    ("downloaded", "release", "released"),
    ("downloaded", "expire", "released"),
    ("submitted", "claim_review", "under_review"),
    ("submitted", "approve", "approved"),
    ("submitted", "reject", "rejected"),
    ("under_review", "approve", "approved"),
    ("under_review", "reject", "rejected"),
    ("under_review", "abandon_review", "submitted"),
    ("rejected", "rework", "assigned"),
    ("rejected", "release", "released"),
    ("rejected", "expire", "released"),
]
OPEN = ("assigned", "downloaded", "rejected")
ACTIVE = ("assigned", "downloaded", "submitted", "under_review", "rejected")
STATUSES = ("pending", "in_progress", "complete", "retired")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "state string, event string, next_state string")


def with_next_state(df: DataFrame) -> DataFrame:
    """df (state, event) with next_state and `legal`; what the table does not name is illegal."""
    found = df.join(F.broadcast(transitions(df.sparkSession)), ["state", "event"], "left")
    return found.withColumn("legal", F.col("next_state").isNotNull())


#: The stamped column of each kind of step.
STAMPS = {"download": "downloaded_at", "submit": "submitted_at", "claim_review": "review_claimed_at", "approve": "decided_at", "reject": "decided_at", "rework": "reworked_at", "release": "released_at", "expire": "released_at"}


def assignment_automaton() -> Automaton:
    """Assignments: attempts counted from 0, steps applied and refused, times of steps. `assign` only opens the first lease."""
    table = {(s, e): n for s, e, n in TRANSITIONS}
    names = list(dict.fromkeys(STAMPS.values()))

    def step(state: str, event: str | None) -> tuple[str, dict, dict]:
        to = table.get((state, event))
        marks = {"deadline": SET} if event == "assign" or to and event == "rework" else {}
        if to:
            marks |= {"downloaded_at": CLEARED, "submitted_at": CLEARED} if event == "rework" else {}
            marks |= {STAMPS[event]: SET} if event in STAMPS else {}
        return to or state, {"reworks": int(bool(to) and event == "rework"), "n_applied": int(bool(to)), "n_refused": int(not to)}, marks

    states = ["assigned", "downloaded", "submitted", "under_review", "approved", "rejected", "released"]
    return tabled(states, ["assign", *STAMPS, "abandon_review"], step, ["reworks", "n_applied", "n_refused"], ["deadline", *names])


ASSIGNMENT = assignment_automaton()
#: The same without times.
UNSTAMPED = Automaton(ASSIGNMENT.states, ASSIGNMENT.events, ASSIGNMENT.after, ASSIGNMENT.adds)


def folded_log(log: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """(key, state, attempt, n_applied, n_refused): each assignment's log folded in order from 'assigned'.

    An event the table does not allow in the current state is refused and changes nothing. Logs are folded in
    stretches that compose (operators/log_fold.py), so one of any length spreads over tasks.
    """
    found = named(folded(stretches(log, key, event, order, UNSTAMPED), key, UNSTAMPED), UNSTAMPED)
    return found.select(key, "state", (F.col("reworks") + 1).cast("int").alias("attempt"), F.col("n_applied").cast("int").alias("n_applied"), F.col("n_refused").cast("int").alias("n_refused"))


def burn_down(df: DataFrame, status: Column) -> DataFrame:
    """(status, n) over all four statuses, zero where none."""
    counts = df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def annotator_record(df: DataFrame, user: str, at: list[str], approved: Column, rejected: Column, submitted: Column) -> DataFrame:
    """(user, approved, rejected, clean_streak, since_rejection).

    clean_streak: approvals after the last rejection; since_rejection: submissions after it, all if there is none.
    """
    when = F.struct(*at)
    last = df.groupBy(user).agg(F.max(F.when(rejected, when)).alias("_last"))
    marked = df.join(last, user)
    later = F.col("_last").isNull() | (when > F.col("_last"))
    return marked.groupBy(user).agg(
        F.count_if(approved).alias("approved"),
        F.count_if(rejected).alias("rejected"),
        F.count_if(approved & later).alias("clean_streak"),
        F.count_if(submitted & later).alias("since_rejection"),
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; partial aggregation on the map side, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def first_preference(df: DataFrame, keys: list[str], name: str, preferred: list[str], value: str) -> DataFrame:
    """(keys, name, value) of the first preferred name that a key has; others are ignored."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(preferred) for x in (n, i)])
    ranked = df.where(F.col(name).isin(preferred))
    best = ranked.groupBy(*keys).agg(F.min(F.struct(F.try_element_at(rank, F.col(name)).alias("r"), F.col(value).alias(value), F.col(name).alias(name))).alias("b"))
    return best.select(*keys, F.col(f"b.{name}"), F.col(f"b.{value}"))


def replica_names(df: DataFrame, case: str, name: Column, order: list[str]) -> DataFrame:
    """df with `replica` (1, 2, ...) by order within a case and `replica_name`: name, then name__r2, name__r3."""
    n = F.row_number().over(W.partitionBy(case).orderBy(*order))
    numbered = df.withColumn("replica", n)
    return numbered.withColumn("replica_name", F.when(F.col("replica") == 1, name).otherwise(F.concat(name, F.lit("__r"), F.col("replica"))))


def duplicate_partner(df: DataFrame, case: str, user: str, key: str, order: list[str]) -> DataFrame:
    """(key, partner): the oldest row of the same case by another user, null if there is none.

    Only the oldest rows of two different users can be anyone's partner, so each case is reduced to
    those two first; no pairs are formed.
    """
    per_user = df.groupBy(case, user).agg(F.min(F.struct(*order, key)).alias("_first"))
    least = per_user.groupBy(case).agg(F.min(F.struct("_first", user)).alias("_a"))
    joined = per_user.join(least, case)
    second = joined.where(F.col(user) != F.col(f"_a.{user}")).groupBy(case).agg(F.min("_first").alias("_b"))
    known = df.join(least, case).join(second, case, "left")
    partner = F.when(F.col(user) != F.col(f"_a.{user}"), F.col(f"_a._first.{key}")).otherwise(F.col(f"_b.{key}"))
    return known.select(key, partner.alias("partner"))


#: Cases that a request looks at in a round.
TRIES = 64


def allocate(requests: DataFrame, cases: DataFrame, taken: DataFrame) -> DataFrame:
    """(user, case): requests matched to free slots of cases, by priority, without double booking.

    requests: user, arrived (unique); cases: case, priority, created, slots (free ones); taken:
    (user, case) pairs that must not meet again. In a round, waiting requests are ranked by arrival
    and cases by (priority desc, created, case); the request of place p asks for the case that holds slot
    p, or for the next one after it that is not forbidden to it, past the last case from the first on; a case
    takes as many as it has slots, in the order of arrival. A request looks at no more than TRIES cases a round, and
    goes on from there in rounds that place nobody, so one with a long past makes few rows. Rounds end
    when nobody is placed and nobody has cases left to look at: then no waiting request has an allowed case with a
    free slot. Without forbidden pairs the result is that of serving one after another.
    """
    won = None
    waiting = requests.select("user", "arrived", F.lit(0).cast("bigint").alias("base"))
    free = cases.where("slots > 0").select("case", "priority", "created", F.col("slots").cast("bigint").alias("slots"))
    # pairs of cases that have no slot to begin with never count
    seen = kept(taken.select("user", "case").join(free.select("case"), "case", "left_semi").distinct())
    while True:
        n, (kinds, slots) = waiting.count(), free.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
        if not (n and slots):
            break
        order = [F.desc("priority"), F.col("created"), F.col("case")]
        ranked = placed(free, order, q=None, start="slots")
        asks = placed(waiting, [F.col("arrived")], r=None).withColumn("slot", F.col("r") % slots)
        held = ranked.where(F.col("start") < n).select("q", F.explode(F.sequence("start", F.least(F.col("start") + F.col("slots"), F.lit(n)) - 1)).alias("slot"))
        met = seen.join(ranked.select("case"), "case", "left_semi").groupBy("user").agg(F.count("*").alias("k"))
        # of k + 1 cases one at least is not forbidden
        looks = asks.join(held, "slot").join(met, "user", "left").withColumn("last", F.least(F.coalesce("k", F.lit(0)), F.lit(kinds - 1)))
        tries = looks.where("base <= last").select("user", "arrived", "q", F.explode(F.sequence("base", F.least(F.col("base") + (TRIES - 1), "last"))).alias("off"))
        tries = tries.withColumn("q", (F.col("q") + F.col("off")) % kinds)
        allowed = tries.join(ranked.select("q", "case", F.col("slots").alias("room")), "q").join(seen, ["user", "case"], "left_anti")
        asked = allowed.groupBy("user", "arrived").agg(F.min_by(F.struct("case", "room"), "off").alias("a")).select("user", "arrived", "a.*")
        # first within cells of a case, so that no task ranks all who ask for it
        cell = W.partitionBy("case", F.pmod(F.xxhash64("user"), F.lit(64))).orderBy("arrived")
        first = asked.withColumn("i", F.row_number().over(cell)).where("i <= room")
        served = first.withColumn("i", F.row_number().over(W.partitionBy("case").orderBy("arrived"))).where("i <= room")
        new = kept(served.select("user", "case"))
        if new.isEmpty():
            if looks.where(F.col("base") + TRIES <= F.col("last")).isEmpty():
                break
            waiting = kept(waiting.withColumn("base", F.col("base") + TRIES))
            continue
        won = new if won is None else won.unionByName(new)
        waiting = kept(waiting.join(new, "user", "left_anti").withColumn("base", F.lit(0).cast("bigint")))
        used = new.groupBy("case").agg(F.count("*").alias("used"))
        left = free.join(used, "case", "left").withColumn("slots", F.col("slots") - F.coalesce("used", F.lit(0)))
        free = kept(left.where("slots > 0").drop("used"))
        seen = kept(seen.unionByName(new))
    return won if won is not None else requests.sparkSession.createDataFrame([], "user bigint, case bigint")


def slot_automaton(wanted: int = 1) -> Automaton:
    """Slots of a case: a state is (wanted, active, approved as far as it matters, retired); approvals and refusals are counted."""
    most = max(wanted, 2)
    states = [(w, a, p, r) for w in dict.fromkeys((wanted, 2)) for a in range(most + 1) for p in range(most + 1) for r in (False, True)]
    states.sort(key=lambda s: s != (wanted, 0, 0, False))  # the first is a new case's

    def step(state: tuple[int, int, int, bool], event: str | None) -> tuple[tuple, dict, dict]:
        want, active, approved, retired = state
        refused = 0
        if event == "claim" and not retired and active + approved < want:
            active += 1
        elif event == "claim_duplicate" and state == (1, 0, 1, False):
            want, active = 2, 1
        elif event in ("claim", "claim_duplicate"):
            refused = 1
        elif event in ("release", "complete"):
            active = max(active - 1, 0)
        done = int(event == "complete")
        return (want, active, min(approved + done, most), retired or event == "retire"), {"approved": done, "refused": refused}, {}

    return tabled(states, ["claim", "claim_duplicate", "release", "complete", "retire"], step, ["approved", "refused"])


def slot_counters(log: DataFrame, case: str, event: str, order: list[str], wanted: int = 1) -> DataFrame:
    """(case, wanted, active, approved, retired, refused) of each case's slot events in order.

    claim takes a slot of a servable case; claim_duplicate asks for a second replica of a finished one and takes
    it in the same step; release and complete give a slot back, never below none; complete also approves;
    retire closes the case. A claim that may not be is refused and changes nothing. Logs are folded in stretches.
    """
    automaton = slot_automaton(wanted)
    found = folded(stretches(log, case, event, order, automaton), case, automaton)
    return slot_columns(found, case, automaton)


def slot_columns(found: DataFrame, case: str, automaton: Automaton) -> DataFrame:
    """(case, wanted, active, approved, retired, refused) of folded slot states."""
    of = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in automaton.states]), F.col("state") + 1)
    return found.select(case, of(0).alias("wanted"), of(1).alias("active"), F.col("approved").cast("int").alias("approved"), of(3).alias("retired"), F.col("refused").cast("int").alias("refused"))


def judged(requests: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """requests (key, at, reviewer, verdict, comment) with outcome, event and slot_event, as rows for the logs.

    states: (key, state). A rejection without a comment is refused (comment_required); of the others the first, by
    (at, reviewer), decides work that is submitted or under review, and the rest come too late
    (bad_state). Of verdicts by one reviewer at one time only one decides: an approval before a rejection. An approval
    also completes the case's slot.
    """
    known = requests.join(states.select(key, "state"), key, "left")
    bare = (F.col("verdict") == "reject") & (F.trim(F.coalesce("comment", F.lit(""))) == "")
    event = F.when(F.col("verdict").isin("approve", "reject"), F.col("verdict"))
    legal = with_next_state(known.withColumn("event", event)).withColumn("fit", F.col("legal") & ~bare)
    first = legal.where("fit").groupBy(key).agg(F.min(F.struct("at", "reviewer")).alias("_first"))
    turn = F.row_number().over(W.partitionBy(key, "at", "reviewer", "fit").orderBy("verdict", "comment"))
    marked = legal.join(first, key, "left").withColumn("_turn", turn)
    marked = marked.withColumn("wins", F.coalesce(F.col("fit") & (F.struct("at", "reviewer") == F.col("_first")) & (F.col("_turn") == 1), F.lit(False)))
    return marked.select(
        key, "at", "reviewer", "verdict",
        F.when(F.col("wins"), F.col("next_state")).when(bare, "comment_required").otherwise("bad_state").alias("outcome"),
        F.when(F.col("wins"), F.col("event")).alias("event"),
        F.when(F.col("wins") & (F.col("event") == "approve"), "complete").alias("slot_event"),
    )


def submitted(df: DataFrame) -> DataFrame:
    """df (state, size, claimed_size, digest, claimed_digest, problems, kind, roll, rate) with outcome, events and slot_event.

    In order: the state must allow it, size and digest agree where they are claimed (digests without regard to case and
    outer blanks), no problem blocks. Work that no review and no score waits for is approved at once.
    """
    differs = lambda a, b, f: F.col(b).isNotNull() & (f(F.col(a)) != f(F.col(b)))
    same = lambda c: c
    review = review_needed(F.col("roll"), F.col("rate"), F.col("kind"), F.lit(None).cast("double"))
    at_once = ~review & (F.col("kind") == NORMAL)
    outcome = (
        F.when(~F.coalesce(F.col("state").isin([s for s, e, _ in TRANSITIONS if e == "submit"]), F.lit(False)), "bad_state")
        .when(differs("size", "claimed_size", same), "size_mismatch")
        .when(differs("digest", "claimed_digest", lambda c: F.lower(F.trim(c))), "checksum_mismatch")
        .when(F.size(blocking(F.col("problems"))) > 0, "failed_validation")
        .when(at_once, "approved")
        .otherwise("submitted")
    )
    found = df.withColumn("outcome", outcome)
    approved = F.col("outcome") == "approved"
    return (
        found.withColumn("needs_review", F.when(F.col("outcome").isin("approved", "submitted"), review))
        .withColumn("events", F.when(approved, F.array(F.lit("submit"), F.lit("approve"))).when(F.col("outcome") == "submitted", F.array(F.lit("submit"))).otherwise(F.array().cast("array<string>")))
        .withColumn("slot_event", F.when(approved, "complete"))
    )


def stamped_log(log: DataFrame, key: str, event: str, at: str, order: list[str], lease: float = 7 * 86400.0) -> DataFrame:
    """(key, state, attempt, deadline, and the last time of each kind of step) of each assignment's log.

    A legal event stamps its time; rework starts an attempt with a new lease and clears download and submission.
    The first row of a log stands for the assignment itself when its event is 'assign'.
    """
    found = named(folded(stretches(log, key, event, order, ASSIGNMENT, at), key, ASSIGNMENT), ASSIGNMENT)
    names = list(dict.fromkeys(STAMPS.values()))
    return found.select(key, "state", (F.col("reworks") + 1).cast("int").alias("attempt"), (F.col("deadline") + lease).alias("deadline"), *names)


def released_all(assignments: DataFrame, disabled: DataFrame, user: str, key: str, state: str = "state") -> DataFrame:
    """(key, event, slot_event): open work of disabled users goes back."""
    open_work = assignments.where(F.col(state).isin(*OPEN)).join(disabled.select(user).distinct(), user, "left_semi")
    return open_work.select(key, F.lit("release").alias("event"), F.lit("release").alias("slot_event"))


def assigned(orders: DataFrame, cases: DataFrame, met: DataFrame) -> DataFrame:
    """orders (user, case) of an administrator with outcome: assigned, had_it (the pair met before), not_servable, or unknown_case.

    cases: (case, wanted, active, approved, retired). Of several orders for one case as many as it has free slots are carried
    out, the smallest users first, and the rest find it not servable; an order that is repeated counts once.
    """
    asked = orders.select("user", "case").distinct()
    free = F.when(F.col("retired"), 0).otherwise(F.greatest(F.lit(0), F.col("wanted") - F.col("active") - F.col("approved")))
    known = asked.join(cases.select("case", free.alias("_free")), "case", "left").join(met.select("user", "case").distinct().withColumn("_met", F.lit(True)), ["user", "case"], "left")
    fit = F.col("_met").isNull() & (F.col("_free") > 0)
    # first within cells of a case, so that no task ranks all orders for one
    cell = W.partitionBy("case", F.pmod(F.xxhash64("user"), F.lit(64))).orderBy("user")
    first = known.where(fit).withColumn("_i", F.row_number().over(cell)).where("_i <= _free")
    given = first.withColumn("_i", F.row_number().over(W.partitionBy("case").orderBy("user"))).where("_i <= _free").select("user", "case", F.lit(True).alias("_given"))
    outcome = F.when(F.col("_free").isNull(), "unknown_case").when(F.col("_given"), "assigned").when(F.col("_met") & (F.col("_free") > 0), "had_it").otherwise("not_servable")
    return known.join(given, ["user", "case"], "left").select("user", "case", outcome.alias("outcome"))


#: After so many failures a score is not tried again; the wait after the first one, which doubles each time (seconds).
GIVE_UP, WAIT = 5, 60.0


def due_scores(submissions: DataFrame, attempts: DataFrame, now: Column, most: int = GIVE_UP, wait: float = WAIT) -> DataFrame:
    """Submissions (key, submitted, kind) that a score is owed, with failures, due (seconds) and status: due, waiting or dead.

    attempts: a log (key, at, ok) of tries, appended to by the worker; a success ends a submission's debt. A failure puts
    it off, each time twice as long, and the `most`-th sets it aside for a reviewer, so rows that can never be scored
    stand in nobody's way. Normal work owes no score.
    """
    tries = attempts.groupBy("key").agg(F.count_if(~F.col("ok")).alias("failures"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("_last"), F.bool_or("ok").alias("_done"))
    owed = submissions.where(F.col("kind").isin(GOLD, DUPLICATE)).join(tries, "key", "left").where("_done IS NULL OR NOT _done").drop("_done")
    failures = F.coalesce("failures", F.lit(0))
    due = F.col("_last") + wait * F.pow(F.lit(2.0), failures - 1)
    status = F.when(failures >= most, "dead").when(due > now, "waiting").otherwise("due")
    return owed.withColumn("failures", failures).withColumn("due", F.when(failures > 0, due)).withColumn("status", status).drop("_last")


def next_scores(submissions: DataFrame, attempts: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    """The worker's next batch: what is due, the oldest first."""
    return due_scores(submissions, attempts, now).where("status = 'due'").orderBy("submitted", "key").limit(limit)


def worker_queue(submissions: DataFrame, limit: int = 25) -> DataFrame:
    """Oldest submissions (kind, scored, submitted, key) that a score is owed: gold and duplicates, at most `limit`.

    A score that failed leaves its row as it is, so the next poll takes it again; see `next_scores` for a log of tries.
    """
    owed = submissions.where(~F.col("scored") & F.col("kind").isin(GOLD, DUPLICATE))
    return owed.orderBy("submitted", "key").limit(limit)
