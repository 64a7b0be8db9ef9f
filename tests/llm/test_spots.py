import re

from pyspark.sql import functions as F

from voxloom.llm import spots


def plain(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in spots.ANCHORS:
            chain, j = [], i + 1
            while j < len(words) and len(chain) < 2:
                skipped = 0
                while j < len(words) and words[j] in spots.ANCHORS and skipped < 9:
                    j, skipped = j + 1, skipped + 1
                if skipped > 8 or j >= len(words):
                    break
                chain.append(words[j])
                j += 1
            if len(chain) == 2:
                out.add(" ".join([w, *chain]))
    if len(out) * 12 < len(words):  # each spot of these texts occurs once
        out |= {" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words)
    return out


def test_signatures_match_plain_python(spark, table):
    texts = ["The house of cards and the fall.", "of the of and is x the y z", "a b c", "one", "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 the y1 y2", "", None, "the " * 20 + "x y", "Die Katze von der Straße ist im Haus", "the cat"]
    rows = table(list(enumerate(texts))).select("text", spots.signatures(F.col("text")).alias("s")).collect()
    for r in rows:
        want = spark.createDataFrame([(x,) for x in plain(r["text"])] or [("",)], "v string")
        hashes = sorted(x["h"] for x in want.select(F.xxhash64("v").bitwiseAND(F.lit(spots.LOW)).alias("h")).collect()) if plain(r["text"]) else []
        assert r["s"] == hashes, r["text"]


def test_next_follows_ids_over_many_runs(spark, table):
    ids = [i * i % 9973 for i in range(1, 3000)]
    ids = sorted(set(ids))
    docs = table([(i, f"t{i}") for i in ids]).repartition(7)
    out = {r["doc_id"]: r["_next"]["text"] for r in spots.with_next(docs, ["text"], rows=50).collect()}
    assert out == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_next_edges(edges, table):
    out = spots.with_next(edges, ["text"])
    assert out.count() == 10 and out.columns == [*edges.columns, "_next"]
    assert spots.with_next(edges.where("false"), ["text"]).count() == 0
    alone = spots.with_next(table([(9, "x")]), ["text"]).collect()
    assert [r["_next"]["text"] for r in alone] == ["x"]
    nulls = spots.with_next(table([(None, "n"), (1, "a")]), ["text"]).collect()
    assert {r["text"]: r["_next"]["text"] for r in nulls} == {"n": "a", "a": "n"}


def test_edit_and_likeness(spark):
    df = spark.createDataFrame([("abcdefghé", "XY"), ("abc", "zzz"), ("", "zzz")], "a string, b string")
    assert [r[0] for r in df.select(spots.edited(F.col("a"), F.col("b"))).collect()] == ["abcdefgXY", "abc", ""]
    sets = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in sets.select(spots.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]


def test_near_pairs_match_brute_force(spark, table):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(30):
        base = [x for _ in range(rng.randrange(5, 40)) for x in ("the", rng.choice(words), rng.choice(words))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            t[rng.randrange(len(t))] = "changed"
            rows.append(" ".join(t))
    docs = table(list(enumerate(rows)))
    signed = docs.select("doc_id", spots.signatures(F.col("text")).alias("sigs"))
    own = {r["doc_id"]: set(r["sigs"]) for r in signed.collect()}
    members, pairs = spots.near_pairs(signed, "doc_id", "sigs", 0.6)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and own[a] and len(own[a] & own[b]) >= 0.6 * len(own[a] | own[b])}
    assert got == want and all(own[i] == own[r] for i, r in rep.items())


def by_place(text):
    """Spots and pairs by a loop over places: any number of anchors is skipped, pairs count in stretches of twelve words."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [i for i, w in enumerate(words) if w not in spots.ANCHORS]
    after = lambda i: [j for j in content if j > i][:2]
    heads = [i for i, w in enumerate(words) if w in spots.ANCHORS and len(after(i)) == 2]
    out = {" ".join([words[i], *[words[j] for j in after(i)]]) for i in heads}
    if not heads:
        return out | ({" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words))
    start = 0
    while start < len(words):
        end = start
        while end < len(words) and end not in heads:
            end += 1
        run = end
        while run < len(words) and run in heads:
            run += 1
        if end - start >= 12:
            whole = words[start:run] + ([words[j] for j in after(end)] if run > end else [])
            out |= {" ".join(p) for p in zip(whole, whole[1:], strict=False)}
        start = run
    return out


def test_signatures_depend_on_the_words_around_only(spark, table):
    import random

    rng = random.Random(7)
    texts = ["the of and to in a is that it for on was x1 x2", "the " * 3000 + "x1 x2", "x1 x2 " + "of " * 30_000]
    for _ in range(150):
        share = rng.choice([0.02, 0.08, 0.3, 0.9])
        texts.append(" ".join(rng.choice(["the", "of", "des"]) if rng.random() < share else f"w{rng.randrange(500)}" for _ in range(rng.randrange(80))))
    hashed = F.array_sort(F.transform("w", lambda v: F.xxhash64(v).bitwiseAND(F.lit(spots.LOW))))
    rows = spark.createDataFrame([(t, sorted(by_place(t))) for t in texts], "text string, w array<string>")
    for r in rows.select("text", spots.signatures(F.col("text")).alias("s"), hashed.alias("h")).collect():
        assert r["s"] == r["h"], r["text"][:300]


def test_near_copies_on_either_side_of_one_spot_in_twelve_words_are_alike(spark):
    base = [f"w{i}" for i in range(90)]
    for i in range(5, 85, 13):
        base[i] = "the"
    more = base[:84] + ["the", "y1", "y2", "the", "y3", "y4"]
    df = spark.createDataFrame([(" ".join(base), " ".join(more))], "a string, b string")
    assert df.select(spots.likeness(spots.signatures(F.col("a")), spots.signatures(F.col("b")))).first()[0] > 0.5
