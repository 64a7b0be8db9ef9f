"""The registered queries of this subpackage, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, decontaminate, fill_in_middle, licenses, lm, neardup, packing, quality, secrets, sharding, spots, toxicity, whitening
from voxloom.llm.labelled import remainder, training_sample
from voxloom.llm.store import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a shingle similarity of 0.75."""
    small_batches(spark)
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word vocabulary; digests of both."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        (F.octet_length("tokens.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens.ids", 256).alias("ids_sha256"),
        F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by a uniform shuffle; texts stay where they are, only ids and digests move."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    # digest and size tell rows with equal ids apart, so a repeated task deals them alike
    return sharding.uniform_shards(docs, ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with its size reduction and differing words."""
    small_batches(spark)
    return licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Labelled documents that the quality model is fitted on, and that the toxicity index is built on: at most so many.
QUALITY_SAMPLE = 3000
TOXICITY_SAMPLE = 3000


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by subword embeddings learned outside the held-out fold."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.trained(training_sample(docs, _table(spark, sf_dir, "labels"), "quality", QUALITY_SAMPLE))
    found = quality.scored(docs, model, out="score")
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the corpus model and under smoothed unigrams."""
    small_batches(spark)
    return lm.scored(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples outside the held-out fold."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.trained(training_sample(docs, _table(spark, sf_dir, "labels"), "toxic", TOXICITY_SAMPLE))
    found = toxicity.scored(docs, index)
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.evidence").alias("evidence"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within one edit in 12 characters."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.passages(docs, _table(spark, sf_dir, "benchmark"))


#: Documents whose runs stand for ordinary identifiers when the secret models are trained: at most so many.
SECRET_SAMPLE = 1000


def secret_ratios(spark: SparkSession, docs: DataFrame, sf_dir: str) -> list[float]:
    """The models' ratios from generated random strings and runs in a bounded sample of labelled documents."""
    ids = _table(spark, sf_dir, "labels").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SECRET_SAMPLE)
    ordinary = secrets.ordinary_samples(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    return secrets.train(secrets.random_samples(spark).unionByName(ordinary))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by rule and by character models."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secret_ratios(spark, docs, sf_dir))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and likeness to that and to the next document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = spots.with_next(docs, ["text", "sigs"], computed={"sigs": spots.signatures(F.col("text"))})
    changed = signed.withColumn("edited", spots.edited(F.col("text"), F.col("_next.text")))
    both = changed.withColumn("edited_sigs", spots.signatures(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spots.fingerprint(F.col("sigs")).alias("fingerprint"),
        spots.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spots.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spots.likeness(F.col("sigs"), F.col("_next.sigs")).alias("near_next"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components, each of variance one; null where a long can't hold the deviation."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at lines and put together for filling in the middle, and restored."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.transformed(docs).select(
        "doc_id",
        F.col("fim.units").alias("n"),
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("fim.output"), F.col("fim.form")).cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_sharding": op7_sharding,
    "op8_lm": op8_lm,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL: dict[str, str] = {
    "op1_neardup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * shared >= 75 * (total - shared)), l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON x = doc_id""",
    "op13_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM p),
r AS (SELECT *, instr(o, '<P>') AS ip, instr(o, '<S>') AS si, instr(o, '<M>') AS im FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN o[4:si - 1] || o[im + 3:] || o[si + 3:im - 1] ELSE o[ip + 3:im - 1] || o[im + 3:] || o[4:ip - 1] END) AS restored_sha256 FROM r""",
}
