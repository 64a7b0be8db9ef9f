"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each document becomes a set of hashed word shingles; equal sets form one class, and only
   the class representative goes on.
2. Bands of the MinHash signature put representatives into buckets. A bucket pairs its first
   and last member with all others, so a bucket of n costs 2n pairs instead of n^2; pairs whose
   short sketches (one bit of each hash) differ too much are dropped at once.
3. A pair's signatures are compared batch by batch; the pair is dropped as soon as, after m of n
   hashes agreed, the posterior probability of a similarity of `threshold` or more is below
   `miss`. Survivors are compared on their full shingle sets.
4. Connected components of the links. Buckets that still hold several components then compare
   their members across components: sizes and sketches (low bits of the hashes, as much as the batches would
   compare) leave few pairs, which are verified on their full sets. In crowded buckets the shingles that
   occur nowhere else and tables of the others also bound what a pair can share; these bounds are exact, so the
   size of a bucket decides on no pair. A large bucket is dealt to cells, and each two cells meet. Components are
   closed again.

A pair at similarity 0.75 shares none of the 32 bands with probability 5.2e-6, in buckets of any size;
sketches and batches lose at most 1e-6 each.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.packed import pack, ranges, unpack
from voxloom.llm.store import released, trimmed, written

WORDS = 5
BANDS, ROWS, BATCH, BITS = 32, 4, 16, 4
#: Long integers of a short sketch, which holds the lowest bit of every hash.
SHORT = BANDS * ROWS // 64
#: Buckets with more pairs between components than so many a member are crowded.
CROWDED = 20
#: Bits of the table of shingles that documents in crowded buckets get.
TABLE = 4096
#: Bytes of packed shingles that a counting task takes.
PART = 12_000_000
#: Members of a cell of a bucket, about.
LARGE = 500
#: Bits of the table that says which texts a comparison needs: at least, at most, and for each needed text.
NEEDED, PER_TEXT = (1 << 20, 1 << 28), 32
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def forget() -> None:
    """Drops the hashes of words at the end of a task, which its worker process outlives."""
    _words.clear()
    trimmed()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * MIX + h[i : len(h) - width + 1 + i]
    return np.unique(_mixed(out))


def permutations(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, np.uint64)


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 512):
        part = sets[i : i + 512]
        np.minimum(out, (part[:, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n agreeing hashes with P(similarity >= threshold | m of n) >= miss, under a uniform prior."""
    s = np.linspace(0, 1, 20_001)[1:-1]
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log - log.max())
        if p[s >= threshold].sum() / p.sum() >= miss:
            return m
    return n


def most_differing(hashes: int, bits: int, threshold: float, miss: float) -> int:
    """Most differing sketch bits of a pair at the threshold, but for a share `miss` of such pairs.

    A sketch holds the low bits of each hash: all agree where the hashes do, and each by chance elsewhere.
    """
    one = np.array([math.comb(bits, d) for d in range(bits + 1)]) * (1 - threshold) / 2**bits
    one[0] += threshold
    total = np.ones(1)
    for _ in range(hashes):
        total = np.convolve(total, one)
    return int(np.searchsorted(np.cumsum(total), 1 - miss))


def sketch(signatures: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of every hash, packed (rows x bytes)."""
    low = (signatures[:, :, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(low.astype(bool).reshape(len(signatures), -1), axis=1)


def _signed(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = permutations(BANDS * ROWS)
        for rows in batches:
            if not len(rows):
                continue
            sets = [shingles(t) for t in rows["text"]]
            out = pd.DataFrame(
                {
                    "id": rows["id"],
                    "n": [len(x) for x in sets],
                    "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                    "signature": [signature(x, a, b).tobytes() if len(x) else None for x in sets],
                }
            )
            low = sketch(np.stack([np.frombuffer(s, np.uint32) if s else np.zeros(BANDS * ROWS, np.uint32) for s in out["signature"]]), 1).view(np.int64)
            for i in range(SHORT):
                out[f"s{i}"] = low[:, i]
            yield out
        forget()

    schema = "id bigint, n bigint, digest binary, signature binary, " + ", ".join(f"s{i} bigint" for i in range(SHORT))
    return df.selectExpr(f"`{key}` AS id", f"`{text}` AS text").mapInPandas(run, schema)


def _bands(signature: str = "signature") -> Column:
    """array<bigint>: a hash of each band of a signature, and of the band's number."""
    width = 4 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col(signature), i * width + 1, F.lit(width)), i))


def _sketched(reps: DataFrame) -> DataFrame:
    """(id, n, sketch, bands) of representatives, the last two array<bigint>."""

    @F.pandas_udf("array<bigint>")
    def run(signatures: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), -1)
        return pd.Series(list(sketch(rows).view(np.int64)))

    return reps.select("id", "n", run("signature").alias("sketch"), _bands().alias("bands"))


def _likely(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b, sa, sb) that no batch of their signatures rules out."""
    least = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            left, right = (np.frombuffer(b"".join(rows[c]), np.uint32).reshape(len(rows), -1) for c in ("sa", "sb"))
            alive = np.arange(len(rows))
            matches = np.zeros(len(rows), np.int64)
            for n, m in least:
                matches[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield rows.iloc[alive][["a", "b"]]
        trimmed()

    return pairs.mapInPandas(run, "a bigint, b bigint")


def _perhaps(ids: DataFrame):
    """Column function: whether an id may be among ids, by a table of bits that has room for them within fixed bounds (32 MB at most)."""
    size = min(NEEDED[1], max(NEEDED[0], 1 << (PER_TEXT * max(1, ids.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    bits = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b"))
    table = np.zeros(size // 8, np.uint8)
    for r in bits.collect():  # bucket k, from 1, has places 32768 * (k - 1) + 1 and on; k = 0 has place 0 alone
        if r["k"] > 0:
            at = 4096 * (r["k"] - 1)
            table[at : at + 4096] = np.frombuffer(bytes(r["b"]), np.uint8)[: len(table) - at]
        else:
            table[-1] |= 128  # place 0 has a bit that no other uses
    spread = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(places: pd.Series) -> pd.Series:
        p = places.to_numpy()
        p = np.where(p == 0, size, p) - 1
        return pd.Series((spread.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0)

    return lambda column: held(F.pmod(F.xxhash64(column), F.lit(size)))


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is among ids: first by the table of bits, then exactly, by a join of what is left.

    So only the needed texts are shuffled; were the table ever full, all of them would be.
    """
    return docs.where(_perhaps(ids)(F.col("id"))).join(ids, "id", "left_semi").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets share percent of their union or more, in integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for rows in batches:
            keep = []
            for a, b, ta, tb in rows[["a", "b", "ta", "tb"]].itertuples(index=False):
                if a not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    kept[a] = shingles(ta)
                x, y = kept[a], shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield rows.loc[keep, ["a", "b"]]
        forget()

    texts = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    texts = texts.join(docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return texts.select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b), for every id that a link names.

    Alternating large-star and small-star steps, each written to the shared folder; what a step
    passes on are links, so no task ever holds a component.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = [F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(u, v))")]
    before = edges.agg(*mark).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = written(small.select("e.u", "e.v").where("u != v").distinct())
        released(edges)
        edges, last = after, before
        before = edges.agg(*mark).first()
        if before == last:
            break
    ends = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends)


def _several(rows: DataFrame) -> DataFrame:
    """Rows (band, id, c) of buckets with several components; how many pairs between components a bucket has, and its largest one."""
    sizes = rows.groupBy("band", "c").agg(F.count("*").cast("double").alias("n"))
    several = sizes.groupBy("band").agg(
        F.sum("n").alias("size"), ((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"), F.max_by("c", F.struct("n", "c")).alias("top")
    )
    return rows.join(written(several.where("pairs > 0")), "band")


def _marked(shared: DataFrame, label: DataFrame) -> DataFrame:
    return shared.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))


def _found_elsewhere(docs: DataFrame) -> DataFrame:
    """(id, m, spare, held): how many of a document's shingles stand in another document (id, text) of docs too, and a table of them.

    Bit i of held is set if such a shingle's hash is i modulo TABLE; spare is m without the bits set. A bit that only
    one of two documents has stands for a shingle that the other lacks, so they share no more than the least spare
    and the bits that both have. Blocks of documents ask for their distinct shingles, packed and cut by ranges of hashes;
    the task of a range counts them and answers with bits. What is shuffled are packed shingles, once each block.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = [shingles(t) for t in rows["text"]]
            if sum(map(len, sets)):
                keys, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                sizes = np.array([len(x) for x in sets], np.uint32)
                block = int.from_bytes(os.urandom(8), "little") >> 1
                yield pd.DataFrame(
                    {"block": [block], "ids": [rows["id"].tolist()], "sizes": [pack(sizes)], "place": [pack(place.astype(np.uint32))],
                     "keys": [pack(np.diff(keys, prepend=np.uint64(0)))], "counts": [pack(counts.astype(np.uint32))]}
                )
        forget()

    schema = "block bigint, ids array<bigint>, sizes binary, place binary, keys binary, counts binary"
    blocks = written(docs.select("id", "text").mapInPandas(gather, schema))
    total = blocks.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / PART))))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, keys, counts in zip(rows["block"], rows["keys"], rows["counts"], strict=True):
                k, n = np.cumsum(unpack(keys, np.uint64), dtype=np.uint64), unpack(counts, np.uint32)
                out = [(p, block, pack(k[a:b]), pack(n[a:b])) for p, a, b in ranges(k, 64, bits)]
                yield pd.DataFrame(out, columns=["part", "block", "keys", "counts"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k, np.uint64) for k in rows["keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        several = np.bincount(place, np.concatenate([unpack(c, np.uint32) for c in rows["counts"]]), len(distinct)) > 1
        cuts = np.cumsum([0, *map(len, keys)])
        own = [pack(several[place[a:b]].astype(np.uint8)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"part": rows["part"], "block": rows["block"], "several": own})

    questions = blocks.select("block", "keys", "counts").mapInPandas(ask, "part int, block bigint, keys binary, counts binary")
    answers = questions.groupBy("part").applyInPandas(answer, "part int, block bigint, several binary")

    def told(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        several = np.concatenate([unpack(x, np.uint8) for x in found.sort_values("part")["several"]])
        sizes, place = unpack(row["sizes"], np.uint32), unpack(row["place"], np.uint32)
        common = several[place] > 0
        of = np.repeat(np.arange(len(sizes)), sizes)[common]
        bit = np.cumsum(unpack(row["keys"], np.uint64), dtype=np.uint64)[place[common]] % np.uint64(TABLE)
        held = np.zeros((len(sizes), TABLE), bool)
        held[of, bit.astype(np.int64)] = True
        m = np.bincount(of, minlength=len(sizes))
        return pd.DataFrame({"id": row["ids"], "m": m, "spare": m - held.sum(axis=1), "held": list(np.packbits(held, axis=1).view(np.int64))})

    asked = blocks.select("block", "ids", "sizes", "place", "keys").groupBy("block")
    return asked.cogroup(answers.groupBy("block")).applyInPandas(told, "id bigint, m bigint, spare bigint, held array<bigint>")


def _across(rows: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): pairs of a bucket in different components whose sizes, shared shingles and sketches allow the similarity.

    In crowded buckets only shingles that stand in several of their documents can be common to a
    pair, and no more of them than their tables have in common: exact bounds that rule out most edited copies below the threshold.
    """
    crowded = F.col("pairs") > CROWDED * F.col("size")
    ids = written(rows.where(crowded).select("id").distinct())
    shared = written(_found_elsewhere(_needed(docs, ids)))
    known = rows.join(_sketched(reps), "id").join(shared, "id", "left").withColumn("j", F.array_position("bands", F.col("band")).cast("int"))
    known = known.withColumn("bands", F.when(F.col("held").isNotNull(), F.col("bands"))).withColumn("m", F.when(crowded & F.col("m").isNotNull(), F.col("m")).otherwise(F.col("n")))
    # cell i of a bucket meets each cell j, so no task holds a large bucket
    cells = F.ceil(F.col("size") / LARGE).cast("int")
    own, each = F.pmod(F.xxhash64("id"), cells).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1))
    cell = {"x": (own.alias("i"), each.alias("k")), "y": (each.alias("i"), own.alias("k"))}
    columns = ("id", "c", "top", "n", "m", "sketch", "spare", "held", "bands", "j")
    x, y = (known.select("band", *cell[k], *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in "xy")

    def ones(name: str, bits: int, both: str) -> Column:
        return sum(F.bit_count(getattr(F.get(f"{name}_x", F.lit(i)), both)(F.get(f"{name}_y", F.lit(i)))) for i in range(bits // 64))

    alike = ones("sketch", BANDS * ROWS * BITS, "bitwiseXOR") <= most_differing(BANDS * ROWS, BITS, percent / 100, miss)
    common = F.least("spare_x", "spare_y") + ones("held", TABLE, "bitwiseAND")
    known_apart = F.col("held_x").isNotNull() & F.col("held_y").isNotNull() & ((100 + percent) * common < percent * (F.col("n_x") + F.col("n_y")))
    alike = alike & ~known_apart
    close = (F.col("n_x") * 100 >= percent * F.col("n_y")) & (F.col("n_y") * 100 >= percent * F.col("n_x"))
    close = close & ((100 + percent) * F.least("m_x", "m_y") >= percent * (F.col("n_x") + F.col("n_y")))
    once = (F.col("c_y") == F.col("top_y")) | (F.col("id_x") < F.col("id_y"))
    # a pair in crowded buckets counts in the first band that it shares
    before = [F.slice(f"bands_{k}", F.lit(1), F.greatest(F.col("j_x") - 1, F.lit(0))) for k in "xy"]
    alike = alike & ~F.coalesce(F.arrays_overlap(*before), F.lit(False))
    # the largest component's members meet the others, not each other
    pairs = x.where("c_x != top_x").join(y, ["band", "i", "k"]).where((F.col("c_x") != F.col("c_y")) & once & close & alike)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, miss: float = 1e-6
) -> DataFrame:
    """(id, n_shingles, component): component is the smallest id that links reach from a document.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of five-word
    shingles (lower-cased A-Z, words split at ASCII white space). A text of fewer words is one
    shingle; null and blank texts have none and stay alone. Keys are integers; a row with a null key
    has a null component and links nothing. Repeated rows share their set, hence their class. Other columns are not looked at.
    """
    given = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = given.where("id IS NOT NULL")
    signed = written(_signed(docs, "id", "text"))
    classes = written(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")))
    members = signed.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = written(members)
    reps = signed.where("digest IS NOT NULL").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    short = [f"s{i}" for i in range(SHORT)]
    reps = written(reps.select("id", "n", "signature", *short))
    released(signed)
    released(classes)

    banded = reps.select("id", *short, F.explode(_bands()).alias("band"))
    full = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    for end in ("low", "high"):
        full = full.join(reps.select(F.col("id").alias(end), F.struct(*short).alias(f"{end}_sketch")), end)
    full = written(full)
    shared = written(banded.join(full, "band"))
    released(full)
    bits = most_differing(BANDS * ROWS, 1, percent / 100, miss)
    ends = F.explode(F.array(*[F.struct(F.col(e).alias("id"), F.col(f"{e}_sketch").alias("sketch")) for e in ("low", "high")])).alias("end")
    differ = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(f"end.sketch.{s}"))) for s in short)
    near = shared.select("id", *short, ends).where((F.col("id") != F.col("end.id")) & (differ <= bits))
    stars = written(near.select(F.least("id", "end.id").alias("a"), F.greatest("id", "end.id").alias("b")).distinct())

    def pruned(pairs: DataFrame) -> DataFrame:
        sides = [reps.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}")) for c in ("a", "b")]
        return _likely(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb"), percent / 100, miss)

    def linked(likely: DataFrame) -> DataFrame:
        likely = written(likely)
        ids = likely.select("a").union(likely.select("b")).distinct().toDF("id")
        return written(_confirmed(likely, written(_needed(docs, ids)), percent))

    links = linked(pruned(stars))
    label = components(links)
    rows = written(_several(_marked(shared, label)))
    # their sketches hold as much of the signatures as the batches would compare
    more = linked(_across(rows, reps, docs, percent, miss).join(stars, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    found = members.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    bare = _signed(given.where("id IS NULL").withColumn("id", F.lit(0).cast("bigint")), "id", "text")
    null = F.lit(None).cast("bigint")
    return found.unionByName(bare.select(null.alias("id"), F.col("n").alias("n_shingles"), null.alias("component")))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """df with one row of each group of near-duplicates: that with the smallest key. Rows with a null key stay.

    Texts of documents that nothing doubles are not shuffled: a table of bits tells most of them.
    """
    keyed = df.where(F.col(f"`{key}`").isNotNull())
    found = near_duplicates(keyed, key, text, percent)
    groups = found.groupBy("id").agg(F.count("*").alias("rows"), F.min("component").alias("component"))
    doubled = written(groups.where("rows > 1 OR id != component").select("id", (F.col("id") == F.col("component")).alias("first")))
    perhaps = _perhaps(doubled.select("id"))(F.col(f"`{key}`"))
    marked = keyed.where(perhaps)
    dropped = doubled.where("NOT first").select(F.col("id").alias(key))
    once = marked.join(dropped, key, "left_anti").dropDuplicates([key])
    return df.where(F.col(f"`{key}`").isNull() | ~perhaps).unionByName(once.select(df.columns))
