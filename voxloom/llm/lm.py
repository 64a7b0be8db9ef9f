"""Scores of a trigram language model with deleted interpolation, learned from the corpus itself.

P(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights for each pair
of buckets of the contexts' frequencies c(u v) and c(v); before a text's first word stands its start, and its
trigram is its bigram. The weights come from expectation-maximisation on a held-out tenth of the
training documents, whose own counts are deleted from the estimates meanwhile; final estimates
use all training counts.

Documents are packed into blocks of bounded size, kept apart by their part in training. A block
asks for the counts of its distinct n-grams once: sorted 56-bit hashes, cut by ranges, go to the
task that owns the range, which adds up what all blocks counted and answers each in the order
of its question. So an n-gram crosses the network once a block and never whole-corpus tables a
task, and frequent n-grams cost no more than rare ones. Two of n distinct n-grams share a hash with
probability n / 2^56 for each, which adds the count of one to the other (for 10^11 of them: one in a million).
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.labelled import remainder
from voxloom.llm.packed import pack, ranges, unpack
from voxloom.llm.store import released, written

BITS = 56
#: Tokens of a block, and n-grams of a counting task, at most (but for one document, or one task's rounding).
BLOCK, PART = 1_000_000, 2_000_000
BUCKETS = 24
HELD_OUT, DELETED, KEPT = 0, 1, 2
END, START = (xxhash.xxh3_64_intdigest(x) >> (64 - BITS) for x in (b"end of text", b"start of text"))  # no word has a space


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Block:
    """Documents of one role, gathered until they are enough."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.words: dict[bytes, int] = {}
        self.at: list[np.ndarray] = []
        self.total = 0

    def add(self, key: int | None, text: str | None) -> None:
        words = tokens(text)
        known = self.words
        self.at.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint32, len(words)))
        self.ids.append(key)
        self.sizes.append(len(words))
        self.total += len(words) + 1

    def row(self, role: int) -> dict:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in self.words), np.uint64, len(self.words))
        return {
            "block": int.from_bytes(os.urandom(8), "little") >> 1,
            "role": role,
            "tokens": self.total,
            "ids": self.ids,
            "sizes": pack(np.array(self.sizes, np.uint32)),
            "words": pack(hashes),
            "at": pack(np.concatenate(self.at)),
        }


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (id as text, text, role)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_blocks: dict[int, _Block] = {}
        for rows in batches:
            for key, text, role in zip(rows["id"], rows["text"], rows["role"], strict=True):
                b = open_blocks.setdefault(role, _Block())
                b.add(None if key is None else int(key), text)
                if b.total >= BLOCK:
                    yield pd.DataFrame([open_blocks.pop(role).row(role)])
        for role, b in open_blocks.items():
            yield pd.DataFrame([b.row(role)])

    schema = "block bigint, role int, tokens bigint, ids array<bigint>, sizes binary, words binary, at binary"
    return docs.mapInPandas(run, schema)


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs, in order."""
    out = (x * np.uint64(0x9E3779B97F4A7C15) + y) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


class _Grams:
    """A block's n-grams: `keys` sorted and distinct, `where` the key of each token, `counts` of each key."""

    def __init__(self, row) -> None:
        self.sizes = unpack(row.sizes, np.uint32).astype(np.int64)
        words, at = unpack(row.words, np.uint64), unpack(row.at, np.uint32)
        hashes = np.concatenate([words, np.array([END, START], np.uint64)])
        docs = len(self.sizes)
        self.ends = np.cumsum(self.sizes + 1)  # places after each document's end token
        after = np.full(int(self.ends[-1]), len(words), np.int64)
        inside = np.ones(len(after), bool)
        inside[self.ends - 1] = False
        after[inside] = at
        before = np.full(len(after), len(words) + 1, np.int64)
        before[1:][inside[:-1]] = after[:-1][inside[:-1]]
        self.starts = np.concatenate([[0], self.ends[:-1]]) if docs else np.empty(0, np.int64)
        self.at_start = before == len(words) + 1
        x, y = hashes[before], hashes[after]
        full = _paired(x, y)
        two = full >> np.uint64(64 - BITS)
        # a trigram is the bigram one token earlier and the token; for first tokens, the bigram again
        earlier = np.concatenate([full[:1], full[:-1]])
        earlier[self.at_start] = np.uint64(START)
        three = _paired(earlier, y) >> np.uint64(64 - BITS)
        one, place = np.unique(hashes[:-1], return_inverse=True)
        self.after, self.before = place[after], place[np.where(self.at_start, len(words), before)]
        self.keys, self.counts = {1: one}, {1: np.bincount(self.after, minlength=len(one))}
        self.keys[2], self.two, self.counts[2] = np.unique(two, return_inverse=True, return_counts=True)
        self.keys[3], self.three, self.counts[3] = np.unique(three, return_inverse=True, return_counts=True)


def _questions(blocks: DataFrame, parts: dict[int, int]) -> DataFrame:
    """(kind, part, block, role, keys, counts): a block's n-grams of one length that fall to one part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                grams, out = _Grams(row), []
                for kind, n in parts.items():
                    keys, counts = grams.keys[kind], grams.counts[kind].astype(np.uint32)
                    for part, a, b in ranges(keys, BITS, n):
                        steps = np.diff(keys[a:b], prepend=np.uint64(0))
                        out.append((kind, part, row.block, row.role, pack(steps), pack(counts[a:b]) if row.role != HELD_OUT else b""))
                yield pd.DataFrame(out, columns=["kind", "part", "block", "role", "keys", "counts"])

    return blocks.mapInPandas(run, "kind int, part int, block bigint, role int, keys binary, counts binary")


def _answers(questions: DataFrame) -> DataFrame:
    """(kind, part, block, role, fresh, kept, deleted): counts over all blocks, in the order of the question's keys.

    fresh, on one row of each part, is how many of its keys training holds.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        total = {role: np.zeros(len(distinct), np.int64) for role in (DELETED, KEPT)}
        for i, (role, counts) in enumerate(zip(rows["role"], rows["counts"], strict=True)):
            if role != HELD_OUT:  # a block's keys are distinct
                total[role][place[cuts[i] : cuts[i + 1]]] += unpack(counts, np.uint32)
        fresh = np.zeros(len(rows), np.int64)
        fresh[0] = ((total[KEPT] + total[DELETED]) > 0).sum()
        out = rows[["kind", "part", "block", "role"]].assign(fresh=fresh)
        for name, role in (("kept", KEPT), ("deleted", DELETED)):
            out[name] = [pack(total[role][place[a:b]].astype(np.uint64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    schema = "kind int, part int, block bigint, role int, fresh bigint, kept binary, deleted binary"
    return questions.groupBy("kind", "part").applyInPandas(run, schema)


def _counts(answers: pd.DataFrame, kind: int, name: str) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("part")
    return np.concatenate([unpack(x, np.uint64) for x in own[name]]).astype(np.int64)


def bucket(counts: np.ndarray) -> np.ndarray:
    """Buckets of context frequency: 0, 1, 2 to 3, 4 to 7 and so on."""
    return np.minimum(np.ceil(np.log2(counts + 1.0)), BUCKETS - 1).astype(np.int64)


def cells(wide: np.ndarray, narrow: np.ndarray) -> np.ndarray:
    """Place of a token's weights, by the counts of its two contexts."""
    return bucket(wide) * BUCKETS + bucket(narrow)


def _weights(stats: DataFrame, uniform: float, rounds: int = 10) -> np.ndarray:
    """Weights (cell x trigram, bigram, unigram, uniform) by expectation-maximisation; a round is a Spark job with one row a cell."""
    n_cells = BUCKETS * BUCKETS
    weights = np.full((n_cells, 4), 1 / 4)
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            for rows in batches:
                sums = np.zeros((n_cells, 4))
                for b, p, q, r, n in zip(rows["cell"], rows["three"], rows["two"], rows["one"], rows["n"], strict=True):
                    b, n = unpack(b, np.uint16), unpack(n, np.uint32)
                    share = weights[b] * np.stack([*(unpack(x, np.float32) for x in (p, q, r)), np.full(len(b), uniform)], axis=1)
                    share *= (n / share.sum(axis=1))[:, None]
                    for k in range(4):
                        sums[:, k] += np.bincount(b, share[:, k], n_cells)
                used = np.flatnonzero(sums.sum(axis=1))
                yield pd.DataFrame({"cell": used} | {c: sums[used, k] for k, c in enumerate("abcd")})

        rows = stats.mapInPandas(expect, "cell int, a double, b double, c double, d double").groupBy("cell").agg(*[F.sum(c) for c in "abcd"]).collect()
        after = np.full((n_cells, 4), 1e-3)
        for r in rows:
            after[r[0]] += r[1:]
        after /= after.sum(axis=1, keepdims=True)
        close = np.abs(after - weights).max() < 1e-4
        weights = after
        if close:
            break
    return weights


def scored(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are split at ASCII white space and lower-cased (A-Z); one end follows them as a token. Rows
    whose crc32(key as text) modulo folds is 0 are held out; the others are learned from, a
    null key too. base_score: add-one-tenth unigrams; score: the model; both log10 of the whole
    text. Null and blank texts are their end alone. Repeated rows count as often as they stand there.
    """
    fold = remainder(F.col(f"`{key}`"), folds)
    role = F.when(fold == 0, HELD_OUT).when(fold == 1, DELETED).otherwise(KEPT)
    blocks = written(_blocks(df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"), role.alias("role"))))
    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    sizes = {r["role"]: r["n"] for r in blocks.groupBy("role").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(sizes.values())
    learned = {role: sizes.get(role, 0) for role in (DELETED, KEPT)}
    bits = max(0, math.ceil(math.log2(max(1, total / PART))))
    answers = written(_answers(_questions(blocks, {1: max(0, bits - 2), 2: bits, 3: bits})))
    fresh = answers.where("kind = 1").agg(F.sum("fresh")).first()[0] or 0
    texts = {r["role"]: r["n"] for r in blocks.groupBy("role").agg(F.sum(F.size("ids")).alias("n")).collect()}
    n_all, uniform = learned[DELETED] + learned[KEPT], 1 / (fresh + 1)

    def found_for(grams: _Grams, found: pd.DataFrame, names: list[str], starts: int) -> tuple[np.ndarray, ...]:
        """Counts of each token, of its bigram and trigram, and of the contexts of both."""
        one, two, three = (sum(_counts(found, kind, name) for name in names) for kind in (1, 2, 3))
        two = two[grams.two]
        narrow = np.where(grams.at_start, starts, one[grams.before])
        wide = np.where(grams.at_start, starts, np.concatenate([two[:1], two[:-1]]))
        return one[grams.after], two, three[grams.three], narrow, wide

    def held(row: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        grams = _Grams(next(row.itertuples(index=False)))
        one, two, three, narrow, wide = found_for(grams, found, ["kept"], texts.get(KEPT, 0))
        p = [three / np.maximum(wide, 1), two / np.maximum(narrow, 1), one / max(learned[KEPT], 1)]
        # tokens with the same numbers count once
        same, n = np.unique(np.stack([cells(wide, narrow), *p], axis=1).astype(np.float32), axis=0, return_counts=True)
        packed = {c: [pack(np.ascontiguousarray(same[:, i]))] for i, c in ((1, "three"), (2, "two"), (3, "one"))}
        return pd.DataFrame({"cell": [pack(same[:, 0].astype(np.uint16))]} | packed | {"n": [pack(n.astype(np.uint32))]})

    asked = answers.where(F.col("role") == DELETED).groupBy("block")
    stats = written(
        blocks.where(F.col("role") == DELETED).groupBy("block").cogroup(asked).applyInPandas(held, "cell binary, three binary, two binary, one binary, n binary")
    )
    weights = _weights(stats, uniform)
    released(stats)

    def score(row: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = next(row.itertuples(index=False))
        grams = _Grams(row)
        one, two, three, narrow, wide = found_for(grams, found, ["kept", "deleted"], texts.get(KEPT, 0) + texts.get(DELETED, 0))
        w = weights[cells(wide, narrow)]
        p = w[:, 0] * three / np.maximum(wide, 1) + w[:, 1] * two / np.maximum(narrow, 1) + w[:, 2] * one / max(n_all, 1) + w[:, 3] * uniform
        base = np.log10((one + 0.1) / (n_all + 0.1 * (fresh + 1)))
        ids = pd.array([None if x is None or x != x else int(x) for x in row.ids], dtype="Int64")
        return pd.DataFrame(
            {
                "id": ids,
                "held_out": row.role == HELD_OUT,
                "n_tokens": grams.sizes + 1,
                "n_known": np.add.reduceat((one > 0).astype(np.int64), grams.starts),
                "train_tokens": n_all,
                "base_score": np.add.reduceat(base, grams.starts),
                "score": np.add.reduceat(np.log10(p), grams.starts),
            }
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)
