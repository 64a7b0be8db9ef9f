import math
import zlib
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import lm


def words(t):
    return (t or "").encode().lower().split()


def reference(rows, weights_of):
    """Counts and base scores by brute force; the model's score with given weights."""
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    learned = [words(t) for i, t in rows if fold[i]]
    one, two, three, start = Counter(), Counter(), Counter(), 0
    for w in learned:
        one.update([*w, lm.END])
        two.update(zip([lm.START, *w], [*w, lm.END], strict=True))
        three.update(zip([lm.START, lm.START, *w], [lm.START, *w], [*w, lm.END], strict=False))
        start += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in rows:
        w = words(t)
        base = score = 0.0
        for z, a, b in zip([lm.START, lm.START, *w], [lm.START, *w], [*w, lm.END], strict=False):
            base += math.log10((one[b] + 0.1) / (n + 0.1 * (v + 1)))
            c = start if a == lm.START else one[a]
            d = start if a == lm.START else two[z, a]
            k = weights_of(d, c)
            score += math.log10(k[0] * three[z, a, b] / max(d, 1) + k[1] * two[a, b] / max(c, 1) + k[2] * one[b] / n + k[3] / (v + 1))
        out[i] = (fold[i] == 0, len(w) + 1, sum(one[x] > 0 for x in [*w, lm.END]), n, base, score)
    return out


@pytest.mark.parametrize("block, part", [(1_500_000, 2_000_000), (150, 40)])
def test_scores_match_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PART", part)
    kept = {}
    own = lm._weights

    def weights(stats, uniform):
        kept["w"] = own(stats, uniform)
        return kept["w"]

    monkeypatch.setattr(lm, "_weights", weights)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["id"]: r for r in lm.scored(docs).collect()}
    want = reference([tuple(r) for r in docs.collect()], lambda d, c: kept["w"][int(lm.cells(np.array([d]), np.array([c]))[0])])
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert np.allclose(kept["w"].sum(axis=1), 1) and (kept["w"] > 0).all()


def test_edges(edges, table):
    got = lm.scored(edges.withColumnRenamed("lang", "tokens").withColumnRenamed("source", "block")).collect()
    assert len(got) == 10
    empty = [r for r in got if r["id"] in (1, 2, 3)]
    assert all(r["n_tokens"] == 1 for r in empty) and all(math.isfinite(r["score"]) for r in got)
    assert lm.scored(edges.where("false")).count() == 0
    alone = lm.scored(table([(None, "a b"), (5, "a b")])).collect()
    assert len(alone) == 2 and any(r["id"] is None for r in alone)


def test_packing():
    a = np.array([0, 5, 2**55], np.uint64)
    assert (lm.unpack(lm.pack(a), np.uint64) == a).all() and len(lm.unpack(lm.pack(a[:0]), np.uint64)) == 0
