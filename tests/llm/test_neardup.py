import random
from itertools import combinations

import numpy as np
import pytest

from voxloom.llm import neardup


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(own), 2):
        both = len(own[a] & own[b])
        if own[a] and own[b] and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


def corpus(seed, groups, size, shared=""):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(30, 120))
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t) + shared)
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, shared", [(1, ""), (2, " " + " ".join(f"common{i}" for i in range(40)))])
def test_components_match_brute_force(table, seed, shared):
    rows = corpus(seed, 25, 12, shared)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in neardup.near_duplicates(table(rows)).collect()}
    assert got == brute(rows)


def test_splitting_crowded_buckets_loses_nothing(table, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 1)
    rows = corpus(5, 20, 8, " " + " ".join(f"common{i}" for i in range(60)))
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in neardup.near_duplicates(table(rows)).collect()}
    assert got == brute(rows)


def test_large_buckets_keep_pairs_of_one_band(spark, table, monkeypatch):
    """Four texts that agree in all low bits but share one band only are all compared, though their bucket is large."""
    monkeypatch.setattr(neardup, "LARGE", 1)
    rng = np.random.default_rng(3)
    low = rng.integers(0, 16, neardup.BANDS * neardup.ROWS, np.uint32)
    signatures = [low + (rng.integers(1, 2**28, len(low), np.uint32) << np.uint32(4)) for _ in range(4)]
    for s in signatures:
        s[: neardup.ROWS] = low[: neardup.ROWS]
    reps = spark.createDataFrame([(i, 96, bytearray(s.tobytes())) for i, s in enumerate(signatures)], "id bigint, n bigint, signature binary")
    docs = table([(i, " ".join(f"w{k}" for k in range(99)) + f" end{i}") for i in range(4)]).selectExpr("doc_id AS id", "text")
    rows = neardup._several(reps.select("id", neardup._bands()[0].alias("band"), reps["id"].alias("c")))
    got = {(r["a"], r["b"]) for r in neardup._across(rows, reps, docs, 75, 1e-6).collect()}
    assert got == set(combinations(range(4), 2))


@pytest.mark.parametrize("crowded", [0, 10**9])
def test_crowded_buckets_keep_what_others_keep(spark, table, monkeypatch, crowded):
    """Texts just above the threshold stay a pair in buckets of any size, whatever sketches may lose."""
    monkeypatch.setattr(neardup, "CROWDED", crowded)
    texts = [(i, " ".join([f"w{k}" for k in range(99)] + [f"end{i}.{k}" for k in range(15)])) for i in range(5)]
    same = bytearray(np.arange(neardup.BANDS * neardup.ROWS, dtype=np.uint32).tobytes())
    reps = spark.createDataFrame([(i, 110, same) for i, _ in texts], "id bigint, n bigint, signature binary")
    marked = neardup.written(reps.select("id", neardup._bands()[0].alias("band"), reps["id"].alias("c")))
    rows = neardup.written(neardup._several(marked))
    got = {(r["a"], r["b"]) for r in neardup._across(rows, reps, table(texts).selectExpr("doc_id AS id", "text"), 75, 0.9).collect()}
    assert got == set(combinations(range(5), 2))


@pytest.mark.parametrize("bits", [64, 4096])
def test_tables_bound_what_documents_share(table, monkeypatch, bits):
    monkeypatch.setattr(neardup, "TABLE", bits)
    rows = corpus(7, 6, 8, " a b c d e f")
    own = {i: sets(t) for i, t in rows}
    found = {r["id"]: r for r in neardup._found_elsewhere(table(rows).selectExpr("doc_id AS id", "text")).collect()}
    for i, s in own.items():
        assert found[i]["m"] == len({x for x in s if any(x in own[j] for j in own if j != i)})
    for i, j in combinations(own, 2):
        both = sum((x & y & (2**64 - 1)).bit_count() for x, y in zip(found[i]["held"], found[j]["held"], strict=True))
        bound = min(found[i]["spare"], found[j]["spare"]) + both
        assert len(own[i] & own[j]) <= bound and (bits == 64 or bound <= 1.3 * len(own[i] & own[j]) + 6)


def test_edges(edges, table):
    got = sorted(tuple(r) for r in neardup.near_duplicates(edges).collect())
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == 10 and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[-5][1] == by[5][1] == by[6][1] == -5 and by[7][1] == 7 and by[7][0] > 900
    assert neardup.near_duplicates(edges.where("false")).count() == 0
    nulls = neardup.near_duplicates(table([(None, "a b c"), (None, None), (2**60 + 1, "a b c"), (2**60 + 2, "A b C")])).collect()
    assert sorted(tuple(r) for r in nulls if r["id"] is not None) == [(2**60 + 1, 1, 2**60 + 1), (2**60 + 2, 1, 2**60 + 1)]
    assert sorted((r["n_shingles"], r["component"]) for r in nulls if r["id"] is None) == [(0, None), (1, None)]


def test_deduplicated_keeps_columns_and_one_of_each_group(edges):
    odd = edges.withColumnRenamed("lang", "id")  # a name the operator uses itself
    out = neardup.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [-5, 1, 2, 3, 4, 7, 8]


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    kept = [neardup.least_matches(n, 0.75, 1e-6) for n in (16, 64, 128)]
    for n, m in zip((16, 64, 128), kept, strict=True):
        assert (rng.binomial(n, 0.75, 200_000) < m).mean() < 1e-3
    assert neardup.least_matches(128, 0.75, 1e-6) > 60
    assert 0 < neardup.most_differing(128, 4, 0.75, 1e-6) < 128


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r["component"] for r in neardup.components(links).collect()} == {0}


def test_whole_table_against_brute_force(spark):
    """Recall and precision on all documents of a table with planted copies: every row agrees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 50
