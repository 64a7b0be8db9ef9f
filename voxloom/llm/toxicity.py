"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of the examples is a term. A term's weight is its inverse document frequency times how
far it separates the labels in the sample: the share of the chi-square statistic (counted as a Spark
job) beyond what chance gives, over a floor that all terms keep, so that no text or example is
left without terms. Examples lie in blocks; the index holds, for each block and term, the postings
and their largest weight. Blocks whose bound, from the largest weights, is below the k-th best
cosine are not read, so the neighbours are exact. Their votes become a probability by a
logistic curve fitted to the examples' own votes, each without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.neardup import BANDS, ROWS, forget, permutations, shingles, signature
from voxloom.llm.store import trimmed, written

WORD = re.compile(r"[^\W\d_]+")
#: Chi-square that some of many terms reach by chance, and the weight that every term keeps (with the whole statistic: 1).
CHANCE, FLOOR = 20.0, 0.002
#: Examples of a block.
BLOCK = 128
#: Terms in more than one of so many examples are kept as rows of all examples instead of lists.
COMMON = 24
#: Added to the votes as a clean one, so that far neighbours alone convince nobody.
DOUBT = 0.05


def counted(text: str | None) -> Counter:
    """How often each lower-case word stands in a text."""
    return Counter(WORD.findall((text or "").lower()))


def term_labels(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of either label that hold the term; (null, toxic, clean) for all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(rows["text"], rows["label"], strict=True):
                n[int(label > 0)].update([*counted(text), None])
            both = list({**n[0], **n[1]})
            yield pd.DataFrame({"term": both, "toxic": [n[1][t] for t in both], "clean": [n[0][t] for t in both]})
        trimmed()

    counts = sample.select("text", "label").mapInPandas(run, "term string, toxic bigint, clean bigint")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def copies(signatures: np.ndarray, least: float = 0.7) -> list[int]:
    """For each row the first one that is a copy or near copy: some band is equal, and so are `least` of all hashes."""
    first: dict[bytes, list[int]] = {}
    out = list(range(len(signatures)))
    for i, row in enumerate(signatures):
        bands = [bytes([b]) + row[b * ROWS : (b + 1) * ROWS].tobytes() for b in range(BANDS)]
        near = {j for b in bands for j in first.get(b, ())}
        for j in sorted(near):
            if (signatures[j] == row).mean() >= least:
                out[i] = j
                break
        else:
            for b in bands:
                first.setdefault(b, []).append(i)
    return out


def without_copies(sample: DataFrame) -> DataFrame:
    """One row, that with the smallest id, of each group of copies or near copies: many of them would make any of their words look telling.

    Texts without words are copies of each other. What comes to the driver are signatures, 512 bytes a row of the bounded sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = permutations(BANDS * ROWS)
        for rows in batches:
            sets = [shingles(t) for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "signature": [signature(s, a, b).tobytes() for s in sets]})
        forget()

    rows = sorted(sample.select("id", "text").mapInPandas(run, "id bigint, signature binary").collect(), key=lambda r: r["id"])
    if not rows:
        return sample
    group = copies(np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows]))
    kept = [(r["id"],) for i, r in enumerate(rows) if group[i] == i]
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, "id bigint")), "id", "left_semi")


def term_weights(sample: DataFrame) -> dict[str, float]:
    """term -> weight, for every word of the sample; nothing if it holds one label only."""
    counts = term_labels(sample)
    whole = counts.where("term IS NULL").first()
    if whole is None or not (whole["toxic"] and whole["clean"]):
        return {}
    n1, n0 = whole["toxic"], whole["clean"]
    n, x, y = n1 + n0, F.col("toxic"), F.col("clean")
    chi = F.try_divide(n * (x * (n0 - y) - y * (n1 - x)).cast("double") ** 2, (x + y) * (n - x - y) * F.lit(float(n1) * n0))
    told = F.greatest(F.coalesce(chi, F.lit(0.0)) - CHANCE, F.lit(0.0)) / n
    weight = F.log1p(F.lit(n) / (x + y)) * (told + FLOOR)
    rows = counts.where("term IS NOT NULL").select("term", weight.alias("weight")).orderBy("term").collect()
    return {r["term"]: r["weight"] for r in rows}


class BlockMaxIndex:
    """ids, labels: of the examples, in the order of their places; curve: of the votes' logistic (level, slope)."""

    def __init__(self, weights: dict[str, float], block: int = BLOCK):
        self.block, self.curve = block, (0.0, 0.0)
        self.row = {t: i for i, t in enumerate(weights)}
        self.weights = np.fromiter(weights.values(), np.float64, len(weights))
        self.ids, self.labels = np.empty(0, np.int64), np.empty(0, np.int8)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, weights): the unit TF-IDF vector of a text's known words."""
        row = self.row
        known = [t for t in counts if t in row]
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        rows = np.fromiter([row[t] for t in known], np.int64, len(known))
        x = (1 + np.log(np.fromiter([counts[t] for t in known], np.float64, len(known)))) * self.weights[rows]
        return rows, x / math.sqrt(x @ x)

    def build(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        """examples: (id, label, rows, weights), those without a known word left out."""
        # like examples lie in one block, which keeps the bounds tight
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (int(e[2][np.argmax(e[3])]), e[1], e[0]))
        terms, self.blocks = len(self.row), -(-len(examples) // self.block)
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int8)
        place = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
        rows = np.concatenate([e[2] for e in examples] or [np.empty(0, np.int64)])
        x = np.concatenate([e[3] for e in examples] or [np.empty(0)]).astype(np.float32)
        # a list that names many examples costs less as a row of all of them
        often = np.flatnonzero(np.bincount(rows, minlength=terms) > len(examples) / COMMON)
        self.common = np.full(terms, -1, np.int32)
        self.common[often] = np.arange(len(often))
        self.full = np.zeros((len(often), self.blocks * self.block), np.float32)
        listed = self.common[rows] < 0
        self.full[self.common[rows[~listed]], place[~listed]] = x[~listed]
        place, rows, x = place[listed], rows[listed], x[listed]
        key = place // self.block * terms + rows
        order = np.argsort(key, kind="stable")
        self.place, self.x = place[order].astype(np.int32), x[order]
        self.start = np.searchsorted(key[order], np.arange(self.blocks * terms + 1)).astype(np.int32)
        self.top = np.zeros((terms, self.blocks), np.float32)
        np.maximum.at(self.top, (rows, place // self.block), x)
        return self

    def _listed(self, blocks: np.ndarray, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What the lists of some blocks add to their examples' cosines; elsewhere 0."""
        key = blocks[:, None] * len(self.row) + rows
        start, size = self.start[key], self.start[key + 1] - self.start[key]
        there = np.flatnonzero(size)
        start, size, x = start.ravel()[there], size.ravel()[there], x[there % len(rows)] if len(rows) else x
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.place[at], self.x[at] * np.repeat(x, size), self.blocks * self.block)

    def nearest(self, rows: np.ndarray, x: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, place) of the k examples with the largest cosines above 0; ties by place."""
        if not (len(rows) and len(self.ids)):
            return []
        common = self.common[rows]
        of, rare = common >= 0, common < 0
        s = (x[of].astype(np.float32) @ self.full[common[of]]).astype(np.float64)
        rows, x = rows[rare], x[rare]
        bound = s.reshape(self.blocks, self.block).max(axis=1) + x @ self.top[rows]
        order = np.argsort(-bound, kind="stable")

        def least() -> float:  # what is added so far never sinks, so the k-th best of it bounds the k-th best cosine
            return float(np.partition(s, -k)[-k]) if len(s) > k else 0.0

        s += self._listed(order[:2], rows, x)
        rest = order[2:][bound[order[2:]] >= least() - 1e-5]
        if len(rest):
            s += self._listed(rest, rows, x)
        low = least()
        hits = np.flatnonzero(s >= low if low > 0 else s > 0)
        return sorted(((float(s[i]), int(i)) for i in hits), key=lambda h: (-h[0], h[1]))[:k]

    def vote(self, rows: np.ndarray, x: np.ndarray, k: int, without: int | None = None) -> tuple[float, list[int]]:
        """Share of toxic votes, each weighing the squared cosine, with the voters' places; `without` is an example that has no vote."""
        near = [h for h in self.nearest(rows, x, k + (without is not None)) if without is None or self.ids[h[1]] != without][:k]
        total = sum(s * s for s, _ in near) + DOUBT
        return sum(s * s for s, i in near if self.labels[i]) / total, [int(self.ids[i]) for _, i in near]

    def score(self, share: float) -> float:
        """Probability of label 1 at a share of toxic votes."""
        level, slope = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, level + slope * share)))) if len(self.ids) else 0.0


def logistic(share: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(level, slope) of the most likely logistic curve, by Newton steps."""
    a = np.stack([np.ones(len(share)), share], axis=1)
    w, hold = np.zeros(2), np.diag([1e-6, ridge / 100])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold, a.T @ (label - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def trained(sample: DataFrame, k: int = 10) -> BlockMaxIndex:
    """The index over a bounded sample (id, text, label); what comes to the driver are its vectors, terms, and one vote a row."""
    sample = written(without_copies(sample))
    index = BlockMaxIndex(term_weights(sample))
    if not index.row:
        return index
    context = sample.sparkSession.sparkContext
    bare = context.broadcast(index)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = bare.value
        for rows in batches:
            found = [at.vector(counted(t)) for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "rows": [r.tobytes() for r, _ in found], "x": [x.tobytes() for _, x in found]})

    rows = sample.select("id", "text", "label").mapInPandas(vectors, "id bigint, label int, rows binary, x binary").collect()
    index.build([(r["id"], int(r["label"] > 0), np.frombuffer(r["rows"], np.int64), np.frombuffer(r["x"], np.float64)) for r in rows])
    spread = context.broadcast(index)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = spread.value
        for rows in batches:
            shares = [at.vote(*at.vector(counted(t)), k, without=i)[0] for i, t in zip(rows["id"], rows["text"], strict=True)]
            yield pd.DataFrame({"share": shares, "label": (rows["label"] > 0).astype("int")})

    own = sample.select("id", "text", "label").mapInPandas(votes, "share double, label int").collect()
    own = sorted((r["share"], r["label"]) for r in own)
    index.curve = logistic(np.array([s for s, _ in own]), np.array([y for _, y in own], np.float64))
    return index


def scored(df: DataFrame, index: BlockMaxIndex, text: str = "text", k: int = 10, out: str = "toxicity") -> DataFrame:
    """df with `out`: struct(score double, evidence array<bigint>): calibrated vote of the k nearest examples, and their ids.

    Null, empty and other texts without a known word have no neighbours and get the curve's level; with an
    index of no examples (an empty sample, or one label only) every score is 0. Equal texts have equal
    scores. A column of df named like `out` is replaced.
    """
    spread = df.sparkSession.sparkContext.broadcast(index)  # bounded by the sample's texts

    @F.pandas_udf("score double, evidence array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        at = spread.value
        for texts in batches:
            found = [at.vote(*at.vector(counted(t)), k) for t in texts]
            yield pd.DataFrame({"score": [at.score(s) for s, _ in found], "evidence": [e for _, e in found]})
        trimmed()

    return df.withColumn(out, run(F.col(f"`{text}`")))
