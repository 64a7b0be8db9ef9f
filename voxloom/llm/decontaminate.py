"""Benchmark passages in documents, allowing for edits.

An item of n characters may differ in k = n // 12 edits. Cut into k + 1 pieces, at least one piece
of it stands unchanged in every such passage (pigeonhole), so documents are searched for pieces
with one automaton, and only around hits is the edit distance computed, with Myers' bit-parallel
columns on whole items. Items are a stated query set: they are taken in blocks of bounded size,
each sent to all tasks, so their number is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.store import trimmed

EDIT_SHARE = 12
#: Characters of items in a block at most (a longer item is a block alone).
BLOCK = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, budget: int) -> tuple[int, int] | None:
        """(distance, end) of the closest substring within the budget, the first of those; else None."""
        if not self.size:
            return None
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, found = full, 0, self.size, None
        for end, c in enumerate(text, 1):
            eq = self.masks.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus = down | (full & ~((eq | minus) | up))
            minus = up & (eq | minus)
            if score <= budget and (found is None or score < found[0]):
                found = (score, end)
        return found


class Items:
    """A block of items, compiled for search."""

    def __init__(self, rows: list[tuple[int, str]], share: int = EDIT_SHARE):
        self.items = [(i, t, len(t) // share) for i, t in rows if t]
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for start, piece in pieces(item, budget):
                at.setdefault(piece, []).append((k, start))
        self.search = ahocorasick.Automaton()
        for piece, places in at.items():
            self.search.add_word(piece, (len(piece), places))
        if at:
            self.search.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the closest passage of each item that text holds within its budget."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.search.iter(text):
            for k, start in places:
                _, item, budget = self.items[k]
                low = max(0, last + 1 - size - start - budget)
                high = min(len(text), last + 1 - size - start + len(item) + budget)
                of = windows.setdefault(k, [])
                # a later piece may ask for an earlier start, as its text can also stand elsewhere in the item
                if of and low <= of[-1][1] and max(high, of[-1][1]) - min(low, of[-1][0]) <= 3 * len(item) + 4 * budget:
                    of[-1] = [min(low, of[-1][0]), max(high, of[-1][1])]
                else:
                    of.append([low, high])
        out = []
        for k, of in windows.items():
            number, item, budget = self.items[k]
            found = None
            for low, high in sorted(of):
                part = text[low:high]
                exact = part.find(item)
                if exact >= 0:
                    hit = (0, low + exact, low + exact + len(item))
                else:
                    if k not in self.patterns:
                        self.patterns[k] = (Pattern(item), Pattern(item[::-1]))
                    there, back = self.patterns[k]
                    near = there.best(part, budget)
                    if near is None:
                        continue
                    distance, end = near
                    size = back.best(part[:end][::-1][: len(item) + budget], distance)
                    hit = (distance, low + end - (size[1] if size else len(item)), low + end)
                if found is None or hit < found:
                    found = hit
                if hit[0] == 0:
                    break
            if found:
                out.append((number, *found))
        return sorted(out)


def _blocks(benchmark: DataFrame, key: str, text: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """Items with a normalised text, in blocks, by id: one block at a time comes to the driver."""
    rows = benchmark.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.dropDuplicates().orderBy("k", "t").toLocalIterator():
        item = normal(r["t"])
        if part and size + len(item) > block:
            yield part
            part, size = [], 0
        part.append((r["k"], item))
        size += len(item)
    if part:
        yield part


def passages(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = BLOCK
) -> DataFrame:
    """(key, item_id, distance, start, end): documents that hold an item within its edit budget.

    One row per document and item with the closest passage; places are those in the text with
    white space collapsed. Null and empty texts and items match nothing; repeated documents give
    repeated rows; an item id with several texts can give several rows.
    """
    spark, out = docs.sparkSession, None
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    for rows in _blocks(benchmark, item, "text", block):
        spread = spark.sparkContext.broadcast(rows)  # at most `block` characters

        def run(batches: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:
            compiled = Items(spread.value)
            for part in batches:
                found = [(d, *m) for d, t in zip(part["doc_id"], part["text"], strict=True) for m in compiled.matches(normal(t))]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"])

        hits = source.mapInPandas(run, "doc_id bigint, item_id bigint, distance int, start int, end int")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], "doc_id bigint, item_id bigint, distance int, start int, end int")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark passage; documents with a null key or text stay.

    Whether a document goes is decided row by row with the items at hand, so texts are not shuffled.
    """
    def holds(rows: list[tuple[int, str]]):
        spread = docs.sparkSession.sparkContext.broadcast(rows)  # at most `block` characters

        @F.pandas_udf("boolean")
        def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            compiled = Items(spread.value)
            for texts in batches:
                yield pd.Series([bool(compiled.matches(normal(t))) for t in texts], dtype=bool)
            del compiled
            trimmed()

        return held(F.col(f"`{text}`"))

    out = docs
    for rows in _blocks(benchmark, "item_id", "text", BLOCK):
        out = out.where(~holds(rows))
    return out
