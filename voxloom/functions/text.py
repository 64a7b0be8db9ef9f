"""Names, sizes, durations, checksums and other small texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of volumes, longest first.
SUFFIXES = (".nii.gz", ".nrrd", ".nhdr", ".nii", ".mha", ".mhd")


def suffix(name: Column, default: str = "") -> Column:
    """The volume extension of a file name in lower case, the longest that fits."""
    low = F.lower(F.coalesce(name, F.lit("")))
    found = F.coalesce(*[F.when(low.endswith(s), s) for s in SUFFIXES])
    return F.coalesce(found, F.lit(default))


def case_name(path: Column) -> Column:
    """File name without directories and volume extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.substring(base, F.lit(1), F.length(base) - F.length(suffix(base)))


def safe_name(name: Column) -> Column:
    """Letters, digits and -_. kept, anything else as _, without . and _ at the ends."""
    kept = F.regexp_replace(F.coalesce(name.cast("string"), F.lit("")), r"[^\p{L}\p{N}\-_.]", "_")
    return F.regexp_replace(kept, r"^[._]+|[._]+$", "")


def walltime_seconds(text: Column) -> Column:
    """Seconds of a limit as SLURM writes it: whole numbers between colons, with days and a dash before them or without; null for anything else.

    The numbers' units follow from where they begin: at hours after a dash or when there are three, else at minutes; a
    single number without days is minutes. So each number is weighed by its place, counted from that beginning.
    """
    halves = F.split(F.trim(text), "-")
    clock = F.split(F.element_at(halves, -1), ":")
    has_days = F.size(halves) == 2
    whole = F.forall(F.concat(F.slice(halves, 1, F.size(halves) - 1), clock), lambda n: n.rlike("^[0-9]+$"))
    begin = F.when(has_days | (F.size(clock) == 3), 0).otherwise(1)
    weights = F.array(F.lit(3600), F.lit(60), F.lit(1))
    weighed = F.transform(clock, lambda n, i: n.try_cast("bigint") * F.get(weights, i + begin))
    days = F.when(has_days, F.get(halves, F.lit(0)).try_cast("bigint")).otherwise(0)
    total = F.aggregate(weighed, days * 86400, lambda sum_, x: sum_ + x)
    return F.when(whole & (F.size(halves) <= 2) & (F.size(clock) <= 3), total)


def walltime_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    days = F.floor(s / 86400)
    return F.when(days > 0, F.concat(days, F.lit("-"), clock)).otherwise(clock)


def human_bytes(n: Column, largest: str = "TB") -> Column:
    """Bytes with a unit up to the largest, one decimal (halves to even) above bytes."""
    units = ["B", "KB", "MB", "GB", "TB"]
    units = units[: units.index(largest) + 1]
    text = lambda i: F.format_string(f"%.1f {units[i]}", F.bround(n / 1024.0**i, 1)) if i else F.format_string("%d B", n.cast("bigint"))
    out = text(len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        out = F.when(F.abs(n) < 1024 ** (i + 1), text(i)).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("bigint"))
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def checksum_matches(expected: Column, actual: Column) -> Column:
    """Without regard to case and outer blanks; an empty expectation passes, an empty checksum does not."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (clean(expected) == "") | ((clean(actual) != "") & (clean(expected) == clean(actual)))


def with_copies(df: DataFrame, digest: str) -> DataFrame:
    """df with `copies`: how many rows share the digest; null digests count among themselves and stay apart from the exchange by digest."""
    counts = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"))
    none = df.where(F.col(digest).isNull())
    n = none.agg(F.count("*").alias("copies"))
    return df.where(F.col(digest).isNotNull()).join(counts, digest).unionByName(none.join(F.broadcast(n)))


def name_hash(name: Column) -> Column:
    """32-bit rolling hash (times 31) over a name's characters, which seeds its colour."""
    codes = F.transform(F.split(name, ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def name_colour(name: Column) -> Column:
    """struct(red, green, blue) from 0 to 1: the hash gives hue, saturation (0.55 and more) and value (0.7 and more).

    A channel of the colour at hue h (in sixths of the circle) is v - v s max(0, min(k, 4 - k, 1)), where k = (n + h) mod 6 and n is
    5 for red, 3 for green and 1 for blue.
    """
    h = name_hash(name)
    # Which bits of the hash make hue, saturation and value, and their ranges.
    hue, s, v = (h % 360) / 60.0, F.lit(0.55) + (F.shiftright(h, 9) % 40) / 100.0, F.lit(0.70) + (F.shiftright(h, 17) % 30) / 100.0

    def channel(n: int) -> Column:
        k = (hue + n) % 6
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(*[channel(n).alias(c) for n, c in ((5, "red"), (3, "green"), (1, "blue"))])


def shell_quoted(path: Column) -> Column:
    """A path as one word for a remote shell."""
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def dice_band(value: Column) -> Column:
    return F.when(value < 0.3, "low").when(value < 0.7, "middle").otherwise("high")


def checkpoint_kind(name: Column) -> Column:
    return F.when(name.contains("best"), "best").when(name.contains("final"), "final").otherwise("latest")


def label_index(text: Column) -> Column:
    """The digits of a segment's text as its label; null if it has none."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).cast("bigint")


def ssh_location(text: Column) -> Column:
    """struct(user_host, path) of 'user@host:/path'; nulls if it is a local path."""
    pattern = r"^((?:[^@/:]+@)?[^@/:]{2,}):(/.*|~.*)$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("host"), part(2).alias("path"))
