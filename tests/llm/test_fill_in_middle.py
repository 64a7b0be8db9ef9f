import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import compare
from voxloom.llm import fill_in_middle, queries


def plain(key, text, rate=100, spm=50):
    """The whole transformation by regular expression and slices of the list of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n\r <PSM>é😀", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_lines_as_the_pattern_cuts_them(text, a, b):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    assert fill_in_middle.pieces(text, a, b) == ("".join(units[:low]), "".join(units[low:high]), "".join(units[high:]), len(units))


@pytest.mark.parametrize("unit, cut", [("word", r"^\s+|[^\s]+\s*"), ("character", r"(?s).")])
def test_other_units(unit, cut):
    for text in ["", " ", "one", " two  words\n here ", "日本 x"]:
        want = re.findall(cut, text)
        for a in range(len(want) + 1):
            p, m, s, n = fill_in_middle.pieces(text, a, len(want), unit)
            assert (p, m, s, n) == ("".join(want[:a]), "".join(want[a:]), "", len(want))


def test_rows_and_restored_texts(spark, table):
    texts = [None, "", "\n", "\n\n", "one", "one\n", "a\nb\nc", "x<P>\ny\n", "<\nP>\n<S\n>\n", "é\n😀\n日本\n" * 40, "ends in <\n<M\n", "\n".join(f"line {i}" for i in range(50_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "one\n"), (5, "one\n"), (None, "no key\nat all\n")]
    found = fill_in_middle.transformed(table(rows).withColumn("fim", F.lit("clash")))
    found = found.withColumn("back", fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r["fim"]) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_rates(spark, table):
    docs = table([(i, f"{i}\nb\nc") for i in range(400)])
    got = fill_in_middle.transformed(docs, rate=30, spm=80).collect()
    assert all(tuple(r["fim"]) == plain(r["doc_id"], r["text"], 30, 80) for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "spm", "psm"}


def test_no_rows(table):
    assert fill_in_middle.transformed(table([])).collect() == []


def test_sql(spark, sf):
    assert compare(queries.QUERIES["op13_fill_in_middle"], queries.SQL["op13_fill_in_middle"], spark, sf) == ""
