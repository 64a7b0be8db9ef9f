import numpy as np

from voxloom.llm import sharding


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([5, 0, 17, 3], [9, 8, 8], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [9, 8, 8]


def test_draws_follow_the_law():
    big = [sharding.hypergeometric(np.random.default_rng(i), 6 * 10**8, 6 * 10**8, 4000) for i in range(400)]
    assert abs(np.mean(big) - 2000) < 8 and 25 < np.std(big) < 39
    counts = np.bincount([sharding.communication_matrix([2, 2], [2, 2], s)[0, 0] for s in range(3000)], minlength=3) / 3000
    assert np.abs(counts - [1 / 6, 4 / 6, 1 / 6]).max() < 0.04


def shards(df, **more):
    out = sharding.uniform_shards(df, ["doc_id"], **more).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return out, by


def test_sizes_slots_and_repeatability(table):
    docs = table([(i, str(i % 7)) for i in range(1000)])
    out, by = shards(docs, shards=24, cells=64, parts=4)
    assert sorted(by) == list(range(24)) and {len(s) for s in by.values()} == {41, 42} and len({r["doc_id"] for r in out}) == 1000
    again, _ = shards(docs.repartition(7), shards=24, cells=64, parts=4)
    place = lambda rows: {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert place(out) == place(again)
    other, _ = shards(docs, shards=24, cells=64, parts=4, seed=7)
    assert place(out) != place(other)


def test_neighbours_scatter(table):
    docs = table([(i, "x") for i in range(2000)])
    out, _ = shards(docs, shards=4, cells=16, parts=2)
    s = [r["shard"] for r in sorted(out, key=lambda r: r["doc_id"])]
    assert 0.2 < np.mean([a == b for a, b in zip(s, s[1:], strict=False)]) < 0.3


def test_edges(edges, table):
    renamed = edges.withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    out, by = shards(renamed, shards=3)
    assert len(out) == 10 and {len(s) for s in by.values()} == {3, 4}
    assert shards(edges.where("false"))[0] == []
    assert len(shards(table([(None, "a"), (None, "b"), (1, None)]), shards=24)[0]) == 3


def test_rows_with_equal_ids_are_dealt_alike_again(table):
    docs = table([(i % 5, f"text {i}") for i in range(300)])
    place = lambda d: {(r["text"], r["shard"], r["slot"]) for r in sharding.uniform_shards(d, ["doc_id", "text"], shards=7).collect()}
    assert place(docs) == place(docs.repartition(9).orderBy("text")) and len(place(docs)) == 300


def test_query_on_the_whole_table(spark, sf):
    import zlib
    from collections import Counter, defaultdict

    from voxloom.llm import queries

    docs = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = queries.op7_sharding(spark, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == docs
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
