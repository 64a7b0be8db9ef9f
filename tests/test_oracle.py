"""Every query with a SQL twin gives the same rows in Spark and DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SQL = {k: v for k, v in entry.oracle_sql().items() if k != "pipeline" and not k.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf):
    found = compare(entry.queries()[name], SQL[name], spark, sf)
    assert found in ("", "no rows"), found


def test_entry_counts_all_documents(spark):
    rows = {r["split"]: r["n"] for r in entry.entry(spark).collect()}
    assert rows == {"test": 17, "train": 149, "val": 34}
