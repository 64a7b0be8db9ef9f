"""Rules of the annotation queue as column expressions: review rates, injection, leases, case status, submission checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, GOLD, DUPLICATE = "normal", "gold", "duplicate"


@dataclass(frozen=True)
class SamplingPolicy:
    """The project's knobs."""

    # Defaults of the annotation protocol.

    training_gate_cases: int = 5
    base_review_rate: float = 0.20
    trusted_review_rate: float = 0.10
    trusted_after_clean: int = 20
    probation_cases: int = 3
    gold_rate: float = 0.05
    duplicate_rate: float = 0.05
    gold_first_case: bool = True
    lease_days: float = 7.0
    stale_heartbeat_hours: float = 72.0
    max_concurrent: int = 1
    gold_dice_flag: float = 0.70
    duplicate_dice_flag: float = 0.70

    def checked(self) -> SamplingPolicy:
        """The policy itself; ValueError if it cannot mean anything."""
        rates = (self.base_review_rate, self.trusted_review_rate, self.gold_rate, self.duplicate_rate)
        if any(not 0 <= r <= 1 for r in rates) or self.gold_rate + self.duplicate_rate > 1:
            raise ValueError("rates must lie in [0, 1], and gold and duplicate rate add up to 1 at most")
        if self.max_concurrent < 1 or self.lease_days <= 0 or min(self.training_gate_cases, self.probation_cases) < 0:
            raise ValueError("limits must be positive")
        return self


def review_rate(approved: Column, rejected: Column, streak: Column, since: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """Chance of review: all work in training and on probation, less for a long clean streak."""
    return (
        F.when(approved + rejected < p.training_gate_cases, 1.0)
        .when((rejected > 0) & (since < p.probation_cases), 1.0)
        .when(streak >= p.trusted_after_clean, p.trusted_review_rate)
        .otherwise(p.base_review_rate)
    )


def review_needed(roll: Column, rate: Column, kind: Column, score: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """A low automatic score forces review; otherwise the roll decides. A null score never flags."""
    low = ((kind == GOLD) & (score < p.gold_dice_flag)) | ((kind == DUPLICATE) & (score < p.duplicate_dice_flag))
    return F.coalesce(low, F.lit(False)) | (roll < rate)


def injection_kind(roll: Column, submitted: Column, gold: Column, duplicate: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """gold, duplicate or normal from one roll; without gold, a roll in its band falls to the duplicates."""
    first = F.lit(p.gold_first_case) & (submitted == 0) & gold
    return (
        F.when(first | (gold & (roll < p.gold_rate)), GOLD)
        .when(duplicate & (roll < p.gold_rate + p.duplicate_rate), DUPLICATE)
        .otherwise(NORMAL)
    )


def can_take_more(open_work: Column, quota_left: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """Under the concurrency limit and, where there is a quota, within it."""
    return (F.coalesce(quota_left, F.lit(1)) > 0) & (open_work < p.max_concurrent)


def quota_remaining(quota: Column, approved: Column) -> Column:
    """Null for no quota."""
    return F.when(quota.isNotNull(), F.greatest(F.lit(0), quota - F.coalesce(approved, F.lit(0))))


def reclaim_reason(assigned: Column, heartbeat: Column, now: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """Why an assignment expires (seconds since the epoch), or null. A missing heartbeat alone is no reason."""
    return F.when(now >= assigned + p.lease_days * 86400, f"lease of {p.lease_days:.3g} days expired").when(
        now - heartbeat >= p.stale_heartbeat_hours * 3600, f"no heartbeat for {p.stale_heartbeat_hours:.3g} hours"
    )


def case_status(wanted: Column, active: Column, approved: Column, retired: Column) -> Column:
    return (
        F.when(retired, "retired")
        .when(approved >= wanted, "complete")
        .when((active > 0) | (approved > 0), "in_progress")
        .otherwise("pending")
    )


def servable(wanted: Column, active: Column, approved: Column, retired: Column) -> Column:
    return ~retired & (active + approved < wanted)


def duplicatable(wanted: Column, active: Column, approved: Column, retired: Column) -> Column:
    return ~retired & (wanted == 1) & (approved == 1) & (active == 0)


# Limits of the submission rules.
STRAY_VOXELS = 8
TOLERANCE_MM = 1e-3
PROBLEM = "array<struct<level:string,code:string,subject:string>>"


def _close(a: Column, b: Column) -> Column:
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= TOLERANCE_MM), lambda ok: ok)
    return (F.size(a) == F.size(b)) & near


def check_submission(counts: Column, required: list[str], optional: list[str], seconds: Column, source: Column | None = None, made: Column | None = None) -> Column:
    """Problems of a submission, errors first, each group in the order of the rules (PROBLEM arrays).

    counts: map of segment to voxels; seconds: time spent, null if unknown; source, made: structs with
    arrays size, spacing, origin, whose empty or null parts are not compared.
    """

    def problem(level: str, code: str, subject: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    rules = []
    for name in [*required, *optional]:
        n = F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0))
        empty = ("error", "empty_required_segment") if name in required else ("warning", "empty_optional_segment")
        rules.append(F.when(n == 0, problem(*empty, F.lit(name))).when(n.between(1, STRAY_VOXELS), problem("error", "stray_voxels", F.lit(name))))
    foreign = F.filter(F.map_entries(counts), lambda e: (F.coalesce(e["value"], F.lit(0)) > 0) & ~e["key"].isin([*required, *optional]))
    extra = F.transform(F.array_sort(F.transform(foreign, lambda e: e["key"])), lambda k: problem("error", "unexpected_segment", k))
    after = []
    if source is not None and made is not None:
        for part in ("size", "spacing", "origin"):
            a, b = source[part], made[part]
            same = a == b if part == "size" else _close(a, b)
            given = (F.size(a) > 0) & (F.size(b) > 0)
            after.append(F.when(given & ~same, problem("error", f"geometry_{part}", F.lit(part))))
    after.append(F.when(seconds < 60, problem("warning", "implausibly_fast", F.format_string("%.0f", seconds.cast("double")))))
    found = F.concat(F.array(*rules), F.coalesce(extra, F.array().cast(PROBLEM)), F.array(*after))
    known = F.filter(found, lambda x: x.isNotNull())
    of = lambda level: F.filter(known, lambda x: x["level"] == level)
    return F.concat(of("error"), of("warning"))


def blocking(problems: Column) -> Column:
    return F.filter(problems, lambda x: x["level"] == "error")


def summary(problems: Column) -> Column:
    """A line for each problem."""
    lines = F.transform(problems, lambda x: F.concat(F.lit("- "), x["code"], F.lit(": "), x["subject"]))
    return F.when(F.size(problems) > 0, F.array_join(lines, "\n")).otherwise("No problems found.")


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves away from zero by its decimal digits (of which six count)."""
    return F.round(x.cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})").cast("string")


def segment_problems(df: DataFrame, name: str = "name", label: str = "label") -> DataFrame:
    """(problem, subject) of a project's segments: none at all, labels below 1, names or labels that several have.

    Settings hold a few segments.
    """
    rows = df.select(F.col(name).alias("name"), F.col(label).cast("int").alias("label"))
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_segments").alias("problem"), F.lit("").alias("subject"))
    low = rows.where("label IS NULL OR label < 1").select(F.lit("background_label"), F.coalesce("name", F.lit("")))
    twice = lambda c, what: rows.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(what), F.col(c).cast("string"))
    return none.union(low).union(twice("name", "duplicate_name")).union(twice("label", "duplicate_label"))


def review_flags(kind: Column, mean_dice: Column, seconds: Column, warnings: Column, p: SamplingPolicy = SamplingPolicy()) -> Column:
    """Reasons to look at a submission: low agreement, little time, and its warnings."""
    gold = kind == GOLD
    low = mean_dice < F.when(gold, p.gold_dice_flag).otherwise(p.duplicate_dice_flag)
    against = F.when(gold, "the reference").otherwise("the other annotator")
    reasons = F.array(
        F.when(low, F.concat(F.lit("mean Dice "), _fixed(mean_dice, 2), F.lit(" against "), against)),
        F.when((seconds > 0) & (seconds < 60), F.concat(F.lit("only "), _fixed(seconds, 0), F.lit(" s spent on the case"))),
    )
    return F.concat(F.filter(reasons, lambda x: x.isNotNull()), F.coalesce(warnings, F.array().cast("array<string>")))
