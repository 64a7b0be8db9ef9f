"""Runs a query in Spark and its SQL in DuckDB and compares rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 9)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def compare(query, sql: str, spark, sf_dir: str) -> str:
    """'' if columns and rows agree, else what differs."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    con.execute("SET TimeZone = 'UTC'")
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    df = query(spark, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    right = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in theirs.fetchall())
    left = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if left == right:
        return "" if left else "no rows"
    return f"{order}: {sum(left.values())} and {sum(right.values())} rows; only Spark {list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}"
