import colorsys

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import folds


def test_rows_without_a_stratum_or_key_stay(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(40)] + [(None, "a"), (None, None)]
    found = folds.stratified_folds(spark.createDataFrame(rows, "k int, s string"), "k", "s", 5).collect()
    assert len(found) == 42
    for s in (None, "a", "b"):
        sizes = [sum(r["fold"] == f and r["s"] == s for r in found) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(x == s for _, x in rows)


def test_ties_of_sizes_put_unknown_by_its_name(spark):
    rows = [(1, "zz"), (2, None), (3, "aa")]
    found = folds.stratified_folds(spark.createDataFrame(rows, "k int, s string"), "k", "s", 3).collect()
    assert {r["s"]: r["fold"] for r in found} == {"aa": 0, None: 1, "zz": 2}


def test_sizes_from_the_data(spark):
    df = spark.range(1, 24).select((F.col("id") % 4).alias("g"), "id").where("g != 2")
    found = {r["g"]: (r["n"], r["expected"], r["as_expected"]) for r in folds.size_report(df, "g", F.max("id"), 4).collect()}
    assert found == {0: (5, 6, False), 1: (6, 6, True), 2: (0, 6, False), 3: (6, 5, False)}


def test_copies_of_null_digests(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None), (5, None)], "k int, d string")
    assert {r["k"]: r["copies"] for r in text.with_copies(df, "d").collect()} == {1: 2, 3: 2, 2: 3, 4: 3, 5: 3}


# Walltimes and their seconds.
@pytest.mark.parametrize("walltime, seconds", [("23:50:00", 85800), ("1-12:00:00", 129600), ("12:30", 750), ("1-12:30", 131400), ("60", 3600), ("1-6", 108000), ("0-6", 21600), (" 5 ", 300), ("", None), ("abc", None), ("1:2:3:4", None), ("24h", None), ("-5", None), ("1--00:00", None), ("1-", None), ("1-2-3", None), ("1:", None), (None, None)])
def test_walltimes(spark, walltime, seconds):
    assert spark.createDataFrame([(walltime,)], "w string").select(text.walltime_seconds(F.col("w"))).first()[0] == seconds


def test_colours_against_the_standard_library(spark):
    names = ["", "a", "heart", "aorta ascendens", "L5", "Ünïcode"] + [f"structure_{i}" for i in range(40)]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.name_hash(F.col("n")).alias("h"), text.name_colour(F.col("n")).alias("c")).collect():
        h = r["h"]
        want = colorsys.hsv_to_rgb((h % 360) / 360, 0.55 + (h >> 9) % 40 / 100, 0.7 + (h >> 17) % 30 / 100)
        assert tuple(r["c"]) == pytest.approx(want, abs=1e-12)
