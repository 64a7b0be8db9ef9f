import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import packing, queries, words

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_words_as_the_library_cuts_them():
    rng, letters = random.Random(1), "ab eéßΣİ'stmdrvl19'½ \n\t!?日本😀<|>ǅ́\x85 "
    encoder = words.BatchEncoder(PATH)
    fixed = ["<|endoftext|>'s", "<|ENDOFTEXT|> a", "don't we'll''s's 're", "'", "''", "a'", "'ss", "", "ΣΑΣ it's WE'LL", " x", "x ", "\x1c end"]
    for k in range(800):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4)] + fixed[k % len(fixed) :][:1] + [None]
        assert [x.tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
    long = [" ".join(f"Wörd{i * i} it's" for i in range(60_000)), "tail"]
    assert [x.tolist() for x in encoder.encode(long)] == [ids(t) for t in long]


def filled(histogram, capacity, plan):
    """Tokens of each sequence; every document has one place, and places in a sequence touch."""
    at = defaultdict(list)
    for x, n in histogram.items():
        for s, o in zip(*plan.places(np.full(n, x), np.arange(n)), strict=True):
            at[int(s)].append((int(o), x))
    for rows in at.values():
        end = 0
        for o, x in sorted(rows):
            assert o == end
            end += x
        assert end <= capacity
    assert len(at) == plan.sequences
    return at


@cache
def fewest(lengths, capacity):
    """Sequences needed at least, by trying everything."""
    if not lengths:
        return 0
    best, seen = len(lengths), set()

    def put(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(lengths):
            best = len(gaps)
            return
        if (k, key := tuple(sorted(gaps))) in seen or seen.add((k, key)):
            return
        for i in {g: i for i, g in enumerate(gaps) if g >= lengths[k]}.values():
            put(k + 1, [*gaps[:i], gaps[i] - lengths[k], *gaps[i + 1 :]])
        put(k + 1, [*gaps, capacity - lengths[k]])

    put(0, [])
    return best


def test_against_trying_everything():
    rng = random.Random(5)
    over = 0
    for _ in range(150):
        capacity = rng.choice([10, 24, 60])
        lengths = tuple(sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True))
        plan = packing.planned(Counter(lengths), capacity)
        filled(Counter(lengths), capacity, plan)
        over += plan.sequences - fewest(lengths, capacity)
    assert over <= 3


@pytest.mark.parametrize("low, high, n, slack", [(1, 4096, 20_000, 1.035), (900, 2200, 20_000, 1.015), (1300, 1400, 9_000, 1.02), (5, 300, 50_000, 1.002)])
def test_near_the_lower_bound(low, high, n, slack):
    rng = np.random.default_rng(low)
    histogram = Counter(rng.integers(low, high + 1, n).tolist())
    plan = packing.planned(histogram)
    filled(histogram, 4096, plan)
    total = sum(x * k for x, k in histogram.items())
    over_half = sum(k for x, k in histogram.items() if x > 2048)
    assert plan.sequences <= slack * max(-(-total // 4096), over_half) + 1


def best_fit_only(histogram, capacity):
    pack = packing._Packer(histogram, capacity)
    for x in sorted(histogram, reverse=True):
        pack.best_fit(x)
    return pack.sequences


def test_configurations_beat_best_fit_where_sizes_are_large():
    histogram = Counter(np.random.default_rng(8).integers(900, 2200, 20_000).tolist())
    assert packing.planned(histogram).sequences < 0.97 * best_fit_only(histogram, 4096)
    few = {2049: 1000, 2047: 1000, 1366: 9999, 1365: 20_000, 1364: 3}
    assert packing.planned(few).sequences == 1000 + 10_001


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(2)
    histogram = Counter(np.minimum(np.exp(rng.normal(6.5, 0.9, 50_000)).astype(int) + 1, 4096).tolist())
    small, large = packing.planned(histogram), packing.planned({x: 10**6 * n for x, n in histogram.items()})
    assert len(large.length) < 2 * len(small.length) + 1000 and large.sequences <= 10**6 * small.sequences


def test_empty_plan():
    assert packing.planned({}).sequences == 0


def check(rows, docs, capacity):
    """Each piece is the library's, and sequences are gapless and not over the capacity."""
    want = Counter()
    for key, text in docs:
        every = [*ids(text), 1]
        for k, at in enumerate(range(0, len(every), capacity)):
            own = every[at : at + capacity]
            want[key, k, at, len(own), zlib.crc32(np.array(own, np.uint32).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_edges(spark, edges):
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()] + [(None, "no key"), (None, "no key")]
    more = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id bigint, text string, length string").withColumn("piece", F.lit(1)).repartition(5)
    pieces = packing.cut(more, PATH, capacity=64, ids=True)
    placed = packing.packed(pieces, 64)
    check(placed.collect(), docs, 64)
    whole = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        ids_ = bytes(whole[r["sequence_id"]]["ids"])
        assert len(ids_) == 4 * whole[r["sequence_id"]]["length"]
        assert ids_[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_no_rows(spark, table):
    assert packing.packed(packing.cut(table([]), PATH)).collect() == []


def test_query_on_the_whole_table(spark, sf):
    rows = queries.op12_packing(spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used = check(rows, docs, 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1
