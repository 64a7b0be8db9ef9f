"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

Each anchor contributes one signature: itself and the next two words that are no anchors.
The set of signatures is the fingerprint; two documents are alike as far as their sets are.
All of it is regular expressions and array functions on the JVM.
"""

from __future__ import annotations

from math import log as _log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Common words of four languages.
ANCHORS = (
    "the of and to in a is that it for on was be with as by this are at from "
    "der die das und von zu den mit sich auf für ist im dem nicht ein eine "
    "de la le les des et un une du que en dans qui sur par pour au est pas "
    "el los las del se por con una su no y o"
).split()


def _either(words: set[str]) -> str:
    """A pattern of just these words, by their beginnings, so that a word is looked up letter by letter."""
    rests: dict[str, set[str]] = {}
    for w in words - {""}:
        rests.setdefault(w[0], set()).add(w[1:])
    if not rests:
        return ""
    return "(?:" + "|".join(c + _either(rest) for c, rest in sorted(rests.items())) + ")" + ("?" if "" in words else "")


_A = _either(set(ANCHORS))
_WORD = rf"(?!{_A} )([^ ]++)"
_MORE = rf"(?: {_A}(?= ))*+"
#: A whole run of anchors, looking ahead over any number of further anchors to each of two content words; each run is read once.
SPOT = rf"(?<= )(?={_A} )(?<! {_A} )({_A}(?= ){_MORE})(?= {_WORD}{_MORE} {_WORD} )"
#: So many words without an anchor of a spot also count as pairs.
STRETCH = 12
LOW = (1 << 32) - 1


def _hashes(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.xxhash64(v).bitwiseAND(F.lit(LOW)))))


def _pairs(words: Column) -> Column:
    """Each word with the next, or the only word."""
    after = F.size(words) - 1
    both = F.zip_with(F.slice(words, F.lit(1), after), F.slice(words, F.lit(2), after), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(after > 0, both).otherwise(words)


def _counted(parts: Column) -> Column:
    """Spots and pairs of a text cut into words outside spots' anchors (even places) and runs of anchors with their two words (odd ones)."""
    runs = F.filter(parts, lambda _, i: i % 2 == 1)
    spots = F.flatten(
        F.transform(runs, lambda r: F.transform(F.split(F.substring_index(r, "\x02", 1), " "), lambda a: F.concat_ws(" ", a, F.substring_index(r, "\x02", -1))))
    )
    # twelve words and the spaces around them have 25 characters at least
    wide = lambda e: (F.length(e) > 2 * STRETCH) & (F.length(e) - F.length(F.replace(e, F.lit(" "), F.lit(""))) > STRETCH)
    alone = lambda e: (F.size(parts) == 1) & (F.trim(e) != "")
    on = lambda i: F.translate(F.try_element_at(parts, i + 2), "\x02", " ")
    stretches = F.transform(parts, lambda e, i: F.when((i % 2 == 0) & (wide(e) | alone(e)), F.split(F.concat_ws(" ", F.trim(e), on(i)), " ")))
    return F.concat(spots, F.flatten(F.transform(F.filter(stretches, lambda w: w.isNotNull()), _pairs)))


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's spots, array<bigint>.

    Where twelve or more words follow each other without an anchor of a spot (lists, foreign or broken
    passages), each pair of following words counts too, on through the spot behind them; so what counts at a
    place depends on the words around it only. A text without spots counts its pairs, or its only
    word; null and blank texts have none. Equal texts have equal signatures.
    """
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(F.concat(F.lit(" "), bare, F.lit(" ")), SPOT, "\x01$1\x02$2 $3\x01")
    # bound to a lambda's variable, the parts are computed once
    return _hashes(F.transform(F.array(F.split(marked, "\x01")), _counted)[0])


def fingerprint(signed: Column) -> Column:
    """The set as text: hexadecimal signatures in order, joined by spaces."""
    return F.array_join(F.transform(signed, lambda x: F.lower(F.hex(x))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are 1.0 alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(1.0))


def with_next(
    df: DataFrame, values: list[str], key: str = "doc_id", rows: int = 2000, most: int = 10_000, computed: dict[str, Column] | None = None
) -> DataFrame:
    """df with `_next`, a struct of the values of the row that follows by key; after the last row comes the first.

    Keys are cut at quantiles into runs of about `rows` rows (at most `most` runs); each run also
    gets a copy of the first row of the next one, so one shuffle by run is enough. Columns that are `computed` are added where the runs are gathered, and
    may be among the values: they cost no shuffle. Null keys come
    first; rows with equal keys follow each other in the order of a hash of their values.
    """
    order = F.coalesce(F.col(f"`{key}`"), F.lit(-(1 << 63)))
    keyed = df.withColumn("_key", order.cast("bigint"))
    n = max(1, min(most, keyed.count() // rows))
    cuts = keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 100_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = F.array(*[F.lit(c) for c in cuts[::step]]).cast("array<bigint>"), F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    reached = lambda a: F.size(F.filter(a, lambda c: c <= F.col("_key")))
    keyed = keyed.withColumn("_coarse", reached(coarse)).withColumn(
        "_run",
        F.when(F.col("_coarse") == 0, 0).otherwise(
            (F.col("_coarse") - 1) * step + reached(F.slice(fine, (F.col("_coarse") - 1) * step + 1, F.lit(step)))
        ).cast("int"),
    ).drop("_coarse")
    firsts = sorted((r["_run"], r["first"]) for r in keyed.groupBy("_run").agg(F.min("_key").alias("first")).collect())
    wrap = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    before = df.sparkSession.createDataFrame(wrap, "_key bigint, _before int")
    places = F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("extra")), F.struct(F.col("_before").alias("run"), F.lit(1).alias("extra")))
    dealt = keyed.join(F.broadcast(before), "_key", "left").withColumn(
        "_place", F.explode(F.when(F.col("_before").isNull(), F.slice(places, 1, 1)).otherwise(places))
    )
    dealt = dealt.withColumns({"_run": F.col("_place.run"), "_extra": F.col("_place.extra")}).drop("_place", "_before").repartition("_run")
    for name, column in (computed or {}).items():
        dealt = dealt.withColumn(name, column)
    names = [F.col(f"`{v}`") for v in values]
    following = W.partitionBy("_run").orderBy("_extra", "_key", F.xxhash64(*names))
    return dealt.withColumn("_next", F.lead(F.struct(*names)).over(following)).where("_extra = 0").drop("_key", "_run", "_extra")


def edited(text: Column, other: Column) -> Column:
    """The last quarter (rounded down) of a text replaced by as many first code points of another, or all it has."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(other, F.lit(1), quarter))


def near_pairs(signed: DataFrame, key: str, sigs: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """((id, rep), (a, b, likeness)): classes of equal sets, and pairs of class representatives that are alike enough.

    Representatives are partitioned by set length: a set of n can only match lengths from
    threshold * n to n / threshold, so a set lies in its own partition and asks in the next one
    too (lengths grow by 1 / threshold). Within a partition only the rarest signatures are indexed, as many as
    one of them must be shared. Rows without signatures match nothing.
    """
    rows = signed.select(F.col(key).alias("id"), F.col(sigs).alias("s"))
    classes = rows.groupBy("s").agg(F.min("id").alias("rep"))
    members = rows.join(classes, "s").select("id", "rep")
    reps = classes.where(F.size("s") > 0).withColumn("n", F.size("s"))
    base = -1 / float(_log(threshold))
    reps = reps.withColumn("part", F.floor(F.log("n") * base + 1e-9))
    frequency = reps.select(F.explode("s").alias("v")).groupBy("v").agg(F.count("*").alias("df"))
    spread = reps.select("rep", "n", "part", F.explode("s").alias("v")).join(frequency, "v")
    ordered = spread.groupBy("rep", "n", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "v"))), lambda x: x["v"]).alias("o"))
    prefix = F.slice("o", F.lit(1), F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1, F.lit(1)).cast("int"))
    kept = ordered.select("rep", "n", "part", F.explode(prefix).alias("v"))
    asked = kept.select(F.col("rep").alias("b"), F.col("n").alias("m"), "v", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    near = (F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n")) & (F.col("rep") != F.col("b"))
    pairs = kept.join(asked, ["part", "v"]).where(near).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    sides = [reps.select(F.col("rep").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
    scored = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, scored.where(F.col("likeness") >= threshold)
