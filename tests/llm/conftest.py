import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edges(table):
    """Nulls, blanks, ties, repeated rows and a very long text."""
    long = " ".join(f"word{i % 997} the of and" for i in range(30_000))
    return table([(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "the cat sat on the mat today"), (6, "the cat sat on the mat today"), (7, long), (7, long), (8, "Ünïcode ẞ 日本 😀 " * 3), (-5, "the cat sat on the mat today")])
