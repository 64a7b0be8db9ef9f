import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import quality, toxicity
from voxloom.llm.labelled import remainder, training_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")]


def held(df, labels, label):
    rows = df.where(remainder(F.col("doc_id"), 5) == 0).join(labels.select("doc_id", label), "doc_id").collect()
    return np.array([r["s"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    model = quality.trained(training_sample(docs, labels, "quality", 3000))
    s, y = held(quality.scored(docs, model, out="s"), labels, "quality")
    assert ((s >= 0.3) == y).mean() > 0.95
    some = docs.limit(40).collect()
    got = {r["doc_id"]: r["s"] for r in quality.scored(docs.sparkSession.createDataFrame(some, docs.schema), model, out="s").collect()}
    assert all(got[r["doc_id"]] == pytest.approx(model.probability(r["text"]), abs=1e-3) for r in some)


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    index = toxicity.trained(training_sample(docs, labels, "toxic", 3000))
    s, y = held(toxicity.scored(docs, index).withColumn("s", F.col("toxicity.score")), labels, "toxic")
    assert ((s >= 0.5) == y).mean() > 0.93 and (s[y == 0] >= 0.5).mean() < 0.03


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    index = toxicity.BlockMaxIndex({f"t{i}": float(rng.uniform(0.5, 4)) for i in range(60)}, block=16)
    vector = lambda: index.vector({f"t{i}": int(rng.integers(1, 4)) for i in rng.choice(60, 6, replace=False)})
    examples = [(i, int(rng.integers(2)), *vector()) for i in range(500)]
    index.build(examples)
    own = {i: dict(zip(r.tolist(), x.tolist(), strict=True)) for i, _, r, x in examples}
    for _ in range(60):
        rows, x = vector()
        want = sorted((sum(w * own[i].get(t, 0.0) for t, w in zip(rows.tolist(), x.tolist(), strict=True)) for i in own), reverse=True)[:10]
        got = [s for s, _ in index.nearest(rows, x, 10)]
        assert np.allclose(got, [w for w in want if w > 0][: len(got)]) and len(got) == min(10, sum(w > 0 for w in want))


def test_every_term_counts_and_copies_are_found(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 40)) + (" awful" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    rows += [(1000, "ten rare things that stand nowhere else at all here", 1), (1001, "the rarest", 0), (1002, "", 0)]
    index = toxicity.trained(spark.createDataFrame(rows, "id bigint, text string, label int"))
    assert set(index.row) == {w for _, t, _ in rows for w in toxicity.counted(t)}
    for key, text, _ in rows[::17] + rows[300:302]:
        score, place = index.nearest(*index.vector(toxicity.counted(text)), 10)[0]
        assert score == pytest.approx(1, abs=1e-5) and index.ids[place] == key
    score = lambda t: index.score(index.vote(*index.vector(toxicity.counted(t)), 10)[0])
    assert score("such an awful wordab") > 0.5 > score("wordab wordac wordad wordba") and 0 < score("") < 0.5


def test_near_copies_count_once(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long, 1), (3, long.replace("w7 ", "x "), 1), (4, "quite another text with some words of its own", 0), (9, long, 0)]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "id bigint, text string, label int")).collect()
    assert {r["id"] for r in kept} == {3, 4}


def test_scores_are_calibrated(tables):
    docs, labels = tables
    index = toxicity.trained(training_sample(docs, labels, "toxic", 3000))
    s, y = held(toxicity.scored(docs, index).withColumn("s", F.col("toxicity.score")), labels, "toxic")
    assert abs(s.mean() - y.mean()) < 0.05 and ((s - y) ** 2).mean() < 0.5 * y.mean() * (1 - y.mean())


def test_grams_cover_whole_tokens():
    token = b"a" * 100
    assert quality.features(token + b"xyz")[1:] != quality.features(token + b"qrs")[1:]
    assert len(quality.features(b"x" * 200_000)) == 3 * 200_000 + 1


def test_edges(spark, edges, tables):
    docs, labels = tables
    nothing = training_sample(docs.where("false"), labels, "toxic", 10)
    index = toxicity.trained(nothing)
    out = toxicity.scored(edges.withColumnRenamed("lang", "toxicity"), index).collect()
    assert len(out) == 10 and {r["toxicity"]["score"] for r in out} == {0.0}
    model = quality.trained(nothing)
    scores = [r["quality"] for r in quality.scored(edges.withColumnRenamed("lang", "quality"), model).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert quality.scored(edges.where("false"), model).count() == toxicity.scored(edges.where("false"), index).count() == 0


def test_sample_keeps_to_its_bound_and_fold(tables):
    docs, labels = tables
    rows = training_sample(docs, labels, "toxic", 25).select("id", (remainder(F.col("id"), 5) == 0).alias("held")).collect()
    assert len(rows) == 25 and not any(r["held"] for r in rows)
    again = {r["id"] for r in training_sample(docs.repartition(5), labels, "toxic", 25).collect()}
    assert again == {r["id"] for r in rows}
