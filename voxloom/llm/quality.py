"""Text quality by supervised subword embeddings.

Every white-space token counts as features hashed into a fixed number of buckets: the token,
its character n-grams, and one more where it repeats the token before. A text is the mean of
its features' vectors; a softmax over it gives the label. Vectors and weights are learned by
stochastic gradient descent in numpy on a bounded sample. For two labels a bucket matters only
by its vector's product with the difference of the weights, so scoring adds one number a token.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
REPEAT = zlib.crc32(b"\x00repeat") % BUCKETS


def features(token: bytes, low: int = 2, high: int = 4) -> list[int]:
    """Buckets of a token and of its character n-grams (as bytes, with marks at both ends)."""
    marked = b"<" + token + b">"
    grams = [zlib.crc32(marked[i : i + n]) % BUCKETS for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(b"\x01" + token) % BUCKETS, *grams]


def repeats(tokens: list[bytes]) -> int:
    return sum(map(operator.eq, tokens, islice(tokens, 1, None)))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's features; the shares sum to 1, or there are none."""
    words = tokens(text)
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        for f in features(w):
            counts[f] += n
    if r := repeats(words):
        counts[REPEAT] += r
    places = np.fromiter(counts, np.int64, len(counts))
    shares = np.fromiter(counts.values(), np.float32, len(counts))
    return places, shares / max(shares.sum(), 1)


@dataclass
class Model:
    """vectors: one per bucket; weights, bias: of the softmax over two labels."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to the logit of label 1."""
        return self.vectors @ (self.weights[1] - self.weights[0])

    def probability(self, text: str | None) -> float:
        places, shares = bag(text)
        z = float(self.margins()[places] @ shares + self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-z))


def fitted(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Gradient descent, one document at a time in a seeded order, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32), np.zeros((2, width), np.float32), np.zeros(2, np.float32))
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            places, shares = bags[i]
            if len(places):
                mean = shares @ model.vectors[places]
                z = model.weights @ mean + model.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                step = rate * (1 - done / steps)
                back = p @ model.weights
                model.weights -= step * np.outer(p, mean)
                model.bias -= 0.1 * step * p
                # shares are small for long texts; their norm keeps the step alike for all lengths
                model.vectors[places] -= (step / max(float(shares @ shares), 1e-3) ** 0.5 * shares)[:, None] * back
            done += 1
    return model


def trained(sample: DataFrame) -> Model:
    """The model of a bounded sample (id, text, label); texts become bags of hashed features before the driver sees them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [bag(t) for t in rows["text"]]
            yield pd.DataFrame(
                {
                    "id": rows["id"],
                    "label": rows["label"],
                    "places": [p.astype(np.uint16).tobytes() for p, _ in found],
                    "shares": [s.astype(np.float32).tobytes() for _, s in found],
                }
            )

    rows = sample.select("id", "text", "label").mapInPandas(run, "id bigint, label int, places binary, shares binary").collect()
    rows.sort(key=lambda r: r["id"])
    bags = [(np.frombuffer(r["places"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return fitted(bags, np.array([int(r["label"] > 0) for r in rows], np.int64))


class _Sums(dict):
    """token -> sum of its features' margins, and their number as the imaginary part, so that one sum adds up both.

    At most `room` tokens are kept here and as many older ones beside, which come back when they are met again.
    """

    def __init__(self, margins: np.ndarray, room: int = 75_000):
        self.table, self.room, self.older = margins.tolist(), room, {}

    def __missing__(self, token: bytes) -> complex:
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        found = self.older.get(token)
        if found is None:
            f = features(token)
            found = complex(sum(map(self.table.__getitem__, f)), len(f))
        self[token] = found
        return found


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """df with `out`: probability of label 1, from whole texts; null, empty and blank texts get the bias alone.

    A column of df named like `out` is replaced.
    """
    spread = df.sparkSession.sparkContext.broadcast((model.margins().astype(np.float64), float(model.bias[1] - model.bias[0])))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margins, bias = spread.value
        known = _Sums(margins)

        def probability(t: str | None) -> float:
            words = tokens(t)
            r = repeats(words)
            whole = sum(map(known.__getitem__, words), complex(r * margins[REPEAT], r))
            z = bias + (whole.real / whole.imag if whole.imag else 0.0)
            return 1 / (1 + np.exp(-z))

        for texts in batches:
            yield pd.Series([probability(t) for t in texts], dtype="float64")

    return df.withColumn(out, run(F.col(f"`{text}`")))
