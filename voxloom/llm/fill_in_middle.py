"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A text is decoded to an array of UTF-32 code points. Comparing the classes of neighbouring
code points and taking flatnonzero gives the places where units begin; the two ranks that
a row's digest chooses index that list, and the three slices are encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle. None may be part of another, nor begin with what another ends with.
MARKS = ("<P>", "<S>", "<M>")
SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def line_starts(points: np.ndarray) -> np.ndarray:
    """Places where lines begin: after each newline; 0 for a text that is not empty."""
    after = points[:-1] == 10
    return np.flatnonzero(np.concatenate([[len(points) > 0], after])) if len(points) else np.zeros(0, np.int64)


def word_starts(points: np.ndarray) -> np.ndarray:
    """Places where words begin, each with the white space after it; white space at the text's start is a unit of its own."""
    if not len(points):
        return np.zeros(0, np.int64)
    space = np.isin(points, SPACES)
    return np.flatnonzero(np.concatenate([[True], space[:-1] & ~space[1:]]))


def character_starts(points: np.ndarray) -> np.ndarray:
    return np.arange(len(points))


UNITS = {"line": line_starts, "word": word_starts, "character": character_starts}


def pieces(text: str, a: int, b: int, unit: str = "line") -> tuple[str, str, str, int]:
    """(prefix, middle, suffix, units): cut after the smaller and the larger of a and b, both modulo units + 1."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.append(UNITS[unit](points), len(points))
    n = len(cuts) - 1
    low, high = sorted((a % (n + 1), b % (n + 1)))
    i, j = int(cuts[low]), int(cuts[high])
    back = lambda x: x.tobytes().decode("utf-32-le")
    return back(points[:i]), back(points[i:j]), back(points[j:]), n


def transformed(
    df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50, out: str = "fim"
) -> DataFrame:
    """df with a struct `out`: units bigint, form string, prefix_chars bigint, middle_chars bigint, output string.

    Four unsigned integers from sha256('seed:key') decide: two ranks, whether a text changes at all (`rate`
    in a hundred), and whether its suffix comes first (`spm` in a hundred). form is psm, spm or plain; texts that
    are empty or hold a mark stay plain, and their counts of characters are null. A null text counts as empty, a null
    key as the empty string; rows with equal keys get equal draws. A column of df named `out` is replaced.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")

    @F.pandas_udf("units bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, a, b, change, order in zip(*batch, strict=True):
                t = t or ""
                prefix, middle, suffix, n = pieces(t, a, b, unit)
                if not t or change % 100 >= rate or any(m in t for m in MARKS):
                    rows.append((n, "plain", None, None, t))
                    continue
                p, s, m = MARKS
                first = order % 100 < spm
                body = f"{s}{suffix}{p}{prefix}{m}{middle}" if first else f"{p}{prefix}{s}{suffix}{m}{middle}"
                rows.append((n, "spm" if first else "psm", len(prefix), len(middle), body))
            found = pd.DataFrame(rows, columns=["units", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return df.withColumn(out, run(F.col(f"`{text}`"), draw(0), draw(1), draw(2), draw(3)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Null stays null.

    Each mark stands once in a changed output: texts that hold one stay plain, and no mark overlaps another.
    """
    p, s, m = MARKS
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
