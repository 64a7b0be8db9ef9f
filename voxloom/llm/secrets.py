"""Secrets in texts: pattern rules, and character Markov models for strings that no rule names.

A first-order model of random strings and one of ordinary identifiers are counted from
labelled samples; a long run of key characters is reported when the log-likelihood ratio
says that it is random. Everything runs as built-in column expressions; texts are not moved.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LIKELY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run with 16 characters or more
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge.
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
#: Symbols of the models: letters of either case, digits, and one for all else.
SYMBOLS = 63
#: Spans that are gathered before they are put by, so that many matches cost no more each than few.
PART = 256
#: Characters that stand in long rows as padding or rulers.
FILLERS = string.ascii_letters + string.digits + "+/_-"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, kind: int, pattern: str, likely: str | None = None) -> Column:
    """Leftmost non-overlapping matches with their places in code points; texts without a match cost one search."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none, parts = F.array().cast(SPAN), F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        full = F.size(acc["last"]) >= PART
        return F.struct(
            end.alias("at"),
            F.when(full, span).otherwise(F.concat(acc["last"], span)).alias("last"),
            F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"]).alias("done"),
        )

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    begin = F.struct(F.lit(0).alias("at"), none.alias("last"), parts.alias("done"))
    found = F.aggregate(pairs, begin, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]))))
    return F.when(text.rlike(likely or pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three rules as array<struct<start, kind, end, value>>, by start, then kind."""
    assign = F.filter(_spans(text, 0, ASSIGN, ASSIGN_LIKELY), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(assign, _spans(text, 1, ACCESS), _spans(text, 2, HEX)))


def _symbols(value: Column) -> Column:
    """array<int> of the models' symbols, in one pass over the string."""

    def symbol(c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a.between(97, 122), a - 97).when(a.between(65, 90), a - 39).when(a.between(48, 57), a + 4).otherwise(SYMBOLS - 1)

    return F.transform(F.split(value, ""), symbol)


def _transitions(value: Column) -> Column:
    """array<int> of symbol pairs, as one number each; empty below two characters."""
    s = _symbols(value)
    pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a * SYMBOLS + b)
    return F.when(F.length(value) >= 2, pairs).otherwise(F.array().cast("array<int>"))


def train(samples: DataFrame, value: str = "value", label: str = "random") -> list[float]:
    """Log-likelihood ratio of each symbol pair, from labelled strings (label true or 1: random), with add-one counts.

    Rows with a null value or label are left out; without samples every ratio is 0. What
    comes to the driver are at most 2 x 63 x 63 counts.
    """
    pair = F.explode(_transitions(F.col(f"`{value}`"))).alias("pair")
    labelled = samples.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{value}`").isNotNull())
    rows = labelled.select(F.col(f"`{label}`").cast("int").alias("label"), pair).groupBy("label", "pair").count().collect()
    n = {(bool(r["label"]), r["pair"]): r["count"] for r in rows}
    out = []
    for a in range(SYMBOLS):
        of = [sum(n.get((k, a * SYMBOLS + b), 0) for b in range(SYMBOLS)) + SYMBOLS for k in (False, True)]
        for b in range(SYMBOLS):
            p, q = ((n.get((k, a * SYMBOLS + b), 0) + 1) / of[k] for k in (True, False))
            out.append(math.log(p) - math.log(q))
    return out


def random_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Random strings over the usual key alphabets (value, random = true), equal in every run."""
    digest = F.unhex(F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256))
    by_alphabet = F.array(F.base64(digest), F.translate(F.base64(digest), "+/=", "xyz"), F.lower(F.hex(F.substring(digest, 1, 6))))
    return spark.range(n).select(F.explode(by_alphabet).alias("value"), F.lit(True).alias("random"))


def ordinary_samples(docs: DataFrame, text: str = "text", numbered: int = 2000) -> DataFrame:
    """Strings that are no secrets (value, random = false).

    Runs in texts that no rule takes for one, dates and counters as they stand in names (`numbered` days and
    numbers), and fillers of one character.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") * 3).cast("int"))
    names = F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"), F.format_string("part-%05d", F.col("id")), F.format_string("_v%d/", F.col("id") % 100))
    spark = docs.sparkSession
    counters = spark.range(numbered).select(F.explode(names).alias("value"))
    filler = F.explode(F.transform(F.split(F.lit(FILLERS), ""), lambda c: F.repeat(c, F.lit(32))))
    known = counters.unionByName(spark.range(1).select(filler.alias("value")))
    return docs.select(F.explode(runs).alias("value")).unionByName(known).withColumn("random", F.lit(False))


def scanned(df: DataFrame, ratios: list[float], threshold: float = 12.0, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with `out`: base and markov spans, array<struct<start, kind, end, value>> (kind: place in KINDS).

    A run is added when its log-likelihood ratio (nats) reaches the threshold and no base span
    touches it. Null and empty texts have no spans; a column of df named like `out` is replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    score = lambda v: F.aggregate(_transitions(v), F.lit(0.0), lambda acc, p: acc + F.get(table, p))
    runs = F.filter(_spans(t, 3, RUN), lambda s: score(s["value"]) >= threshold)
    staged = df.withColumn("_base", base_spans(t)).withColumn("_runs", runs)
    free = F.filter("_runs", lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return staged.withColumn(out, F.array_sort(F.concat("_base", free))).drop("_base", "_runs")


def redacted(df: DataFrame, spans: str = "secrets", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans are replaced together. Null texts stay null."""
    s, t = F.col(f"`{spans}`"), F.col(f"`{text}`")
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.concat(
            acc["done"],
            F.when(
                x["start"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
            ).otherwise(F.lit("")),
        ).alias("done"),
    )
    end = lambda acc: F.concat(acc["done"], F.substring(t, acc["at"] + 1, F.length(t)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return df.withColumn(text, F.when(F.size(s) > 0, F.aggregate(s, start, step, end)).otherwise(t))


def joined(spans: Column) -> Column:
    """'kind:start:end' of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
