import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from voxloom.llm import queries
from voxloom.llm.decontaminate import normal

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["tokens"] == kept["secrets"] == kept["decontamination"] <= kept["near-duplicates"] <= kept["toxicity"] <= set(before)
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in normal(before[d]) for d in kept["tokens"] for i in items)
    texts = [before[d] for d in kept["near-duplicates"]]
    assert len(set(texts)) == len(texts) and len(kept["tokens"]) > 100


def test_run_gives_the_same(spark):
    rows = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert rows == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, edges, table, stage):
    docs = edges.unionByName(table([(None, "null key"), (None, None)]))
    out = stage(spark, docs, SF)
    assert out.count() >= 8
    assert stage(spark, edges.where("false"), SF).count() == 0


def test_contract_columns(spark):
    want = {
        "op1": {"doc_id", "n_shingles", "component_id", "kept"},
        "op2": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op4": {"doc_id", "held_out", "score", "predicted"},
        "op6": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
        "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op8": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op9": {"doc_id", "held_out", "score", "predicted"},
        "op10": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op11": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
        "op12": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op13": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    }
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    for name, query in queries.QUERIES.items():
        key = name.split("_")[0]
        if key in want:
            out = query(spark, SF)
            assert want[key] <= set(out.columns), name
            found = out.select("doc_id").distinct().count() if key == "op12" else out.count()
            assert found == (8 * vectors if key == "op11" else 200), name
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_shard_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op7_sharding(spark, SF).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
