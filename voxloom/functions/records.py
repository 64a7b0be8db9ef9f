"""Records, settings and label sets: defaults, precedence, version gates, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOL = 1


def protocol_ok(version: Column, supported: int = PROTOCOL) -> Column:
    """Clients of a newer or older major protocol are refused; a missing version counts as current."""
    return F.coalesce(version, F.lit(supported)) == supported


def error_of(body: Column) -> Column:
    """struct(code, message) of an error body, flat or nested under 'error'; nulls if it is none."""
    nested = lambda k: F.coalesce(F.get_json_object(body, f"$.error.{k}"), F.get_json_object(body, f"$.{k}"))
    return F.struct(nested("code").alias("code"), nested("message").alias("message"))


def first_given(*values: Column) -> Column:
    """Flag over environment over local file over template."""
    return F.coalesce(*values)


def by_rules(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The group of the first rule that fits: 'prefix*' or an exact name."""
    out = F.lit(default)
    for pattern, group in reversed(rules):
        fits = name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern
        out = F.when(fits, group).otherwise(out)
    return out


def spacing_warning(planned: Column, limit: Column) -> Column:
    """Whether the coarsest planned spacing exceeds a limit; false without one."""
    return F.coalesce(F.array_max(planned) > limit, F.lit(False))


def _repeated(rows: DataFrame, name: str, column: str) -> DataFrame:
    """(name, _column) for each value of the column, null aside, that stands more than once in a set."""
    several = rows.where(F.col(column).isNotNull()).groupBy(name, column).agg(F.count("*").alias("_k")).where("_k > 1")
    return several.select(name, F.lit(column).alias("_column"))


def label_set_report(labels: DataFrame, name: str, structure: str, index: str, source: str | None = None) -> DataFrame:
    """(name, n, contiguous, unique_names, source_injective) of label sets: indices must be 1 to N.

    What is counted is which values repeat: only those meet their set's row again, and one of many labels is no single task's.
    """
    columns = list(dict.fromkeys(c for c in (structure, index, source) if c))
    none = lambda kind: F.lit(None).cast(kind)
    sums = [
        F.count("*").alias("n"), F.count(index).alias("_indices"), F.count(structure).alias("_names"), F.min(index).cast("double").alias("_low"), F.max(index).cast("double").alias("_high"),
        (F.coalesce(F.min(source) != 0, F.lit(True)) if source else F.lit(True)).alias("_fine"),
    ]
    rows = labels.groupBy(name).agg(*sums).withColumn("_column", none("string"))
    empty = [none(f.dataType).alias(f.name) for f in rows.schema if f.name not in (name, "_column")]
    for c in columns:
        rows = rows.unionByName(_repeated(labels.select(*dict.fromkeys([name, c])), name, c).select(name, *empty, "_column"))
    once = lambda c: ~F.coalesce(F.bool_or(F.col("_column") == c), F.lit(False))
    n = F.max("n")
    checks = [
        n.alias("n"),
        ((F.max("_low") == 1) & (F.max("_high") == n) & (F.max("_indices") == n) & once(index)).alias("contiguous"),
        ((F.max("_names") == n) & once(structure)).alias("unique_names"),
    ]
    if source:
        checks.append((once(source) & F.bool_and("_fine")).alias("source_injective"))
    return rows.groupBy(name).agg(*checks)


def zipped(names: Column, values: Column) -> Column:
    """Map of names to values by position, null unless the lengths agree."""
    return F.when(F.size(names) == F.size(values), F.map_from_arrays(names, values))


def inverted(m: Column) -> Column:
    """A map with keys and values exchanged."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def seen_by(assignments: DataFrame, admin: bool) -> DataFrame:
    """Assignments with the columns that a viewer may know: whether work is gold, a duplicate or normal is for administrators only."""
    return assignments if admin else assignments.drop("kind")
