import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import voxels
from voxloom.sources import volumes


def rows(spark, mask, case=0, label=1):
    return spark.createDataFrame([(case, label, *map(int, p)) for p in np.argwhere(mask)], "s int, label int, x int, y int, z int")


def cube(shift=0):
    m = np.zeros((16, 16, 16), bool)
    m[4 + shift : 12 + shift, 4:12, 4:12] = True
    return m


@pytest.mark.parametrize("shift, dice", [(0, 1.0), (1, 0.875), (3, 0.625)])
def test_dice_and_hd95(spark, shift, dice):
    r = voxels.score_cases(rows(spark, cube()), rows(spark, cube(shift)), ["s"], (1.0, 1.0, 1.0)).first()
    assert r["dice"] == pytest.approx(dice)
    assert r["hd95"] == pytest.approx(shift) and (r["nsd"] == 1.0) is (shift <= 1)


def test_one_side_only(spark):
    r = voxels.score_cases(rows(spark, cube()), rows(spark, cube()).where("false"), ["s"], (1.0, 1.0, 1.0)).first()
    assert (r["dice"], r["nsd"], r["hd95"]) == (0.0, 0.0, float("inf"))


def test_surface_is_what_erosion_removes(spark):
    rng = np.random.default_rng(1)
    m = rng.random((7, 6, 5)) < 0.7
    p = np.pad(m, 1)
    inner = p[1:-1, 1:-1, 1:-1].copy()
    for axis in range(3):
        for d in (-1, 1):
            inner &= np.roll(p, d, axis)[1:-1, 1:-1, 1:-1]
    got = {(r["x"], r["y"], r["z"]) for r in voxels.surface(rows(spark, m), ["s"]).collect()}
    assert got == {tuple(map(int, q)) for q in np.argwhere(m & ~inner)}


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = (rng.random((rng.integers(1, 900), 3)) * [40, 3, 3] for _ in range(2))
        want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
        assert np.allclose(voxels.nearest(a, b, 64), want)


@pytest.mark.parametrize("policy, winner", [("smaller_wins", 4), ("label_order", 64)])
def test_overlap(spark, policy, winner):
    big, small = np.ones((4, 4, 4), bool), np.zeros((4, 4, 4), bool)
    small[0, 0, :] = True
    claims = rows(spark, big, label=2).unionByName(rows(spark, small, label=1))
    merged, collisions = voxels.merge_masks(claims, ["s"], policy)
    counts = {r["label"]: r["count"] for r in merged.groupBy("label").count().collect()}
    assert counts == ({1: 4, 2: 60} if policy == "smaller_wins" else {2: 64})
    assert collisions.first()["collisions"] == 4


def test_smaller_wins_equals_pairwise_folding(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((4, 4, 4)) < p for p in (0.5, 0.5, 0.3, 0.8)]
    sizes = [int(m.sum()) for m in masks]
    want = np.zeros((4, 4, 4), int)
    for i, m in enumerate(masks, 1):
        for q in map(tuple, np.argwhere(m)):
            if want[q] == 0 or sizes[i - 1] < sizes[want[q] - 1]:
                want[q] = i
    claims = None
    for i, m in enumerate(masks, 1):
        part = rows(spark, m, label=i)
        claims = part if claims is None else claims.unionByName(part)
    merged, _ = voxels.merge_masks(claims, ["s"])
    assert all(want[r["x"], r["y"], r["z"]] == r["label"] for r in merged.collect())


def test_orthonormalised_is_orthonormal(spark):
    tilt = [0.4, 2e-4, 0.0, -1e-4, 0.4, 0.0, 0.0, 3e-4, 0.5]
    df = spark.createDataFrame([(tilt,), ([0.0] * 9,)], "m array<double>")
    got = df.select(voxels.direction_error(F.col("m")).alias("before"), voxels.orthonormalised(F.col("m")).alias("f")).withColumn("after", voxels.direction_error(F.col("f"))).collect()
    assert got[0]["before"] > 1e-5 and got[0]["after"] < 1e-12
    assert np.allclose(np.linalg.norm(np.reshape(got[0]["f"], (3, 3)), axis=0), np.linalg.norm(np.reshape(tilt, (3, 3)), axis=0))
    assert got[1]["before"] == float("inf") and got[1]["f"] is None


def test_volume_round_trip(spark, tmp_path):
    data = np.zeros((5, 4, 3), np.uint8)
    data[1, 2, 0], data[4, 3, 2] = 7, 2
    affine = np.diag([0.4, 0.4, 0.5, 1.0])
    affine[:3, 3] = [1, 2, 3]
    content = volumes.header(data.shape, (0.4, 0.4, 0.5), affine) + data.tobytes(order="F")
    (tmp_path / "a.nii").write_bytes(content)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(content))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r["label"], r["x"], r["y"], r["z"]) for r in volumes.label_rows(files).collect()}
    assert got == {(7, 1, 2, 0), (2, 4, 3, 2)}
    for g in volumes.geometry(files).collect():
        assert g["size"] == [5, 4, 3] and g["origin"] == [1.0, 2.0, 3.0] and g["spacing"] == pytest.approx([0.4, 0.4, 0.5])


def test_signed_rank_small_or_equal(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)] * 8 + [("b", 1.0, 2.0)] * 3 + [("c", float(i), float(i * i % 5)) for i in range(9)] + [("c", float("nan"), 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in voxels.signed_rank(df, ["g"], "x", "y").collect()}
    assert got["a"]["w"] is None and got["b"]["w"] is None and got["c"]["n"] == 9
    d = [i - i * i % 5 for i in range(9) if i != i * i % 5]
    ranks = {m: np.mean([k + 1 for k, v in enumerate(sorted(map(abs, d))) if v == m]) for m in set(map(abs, d))}
    assert got["c"]["w"] == min(sum(ranks[abs(v)] for v in d if v > 0), sum(ranks[abs(v)] for v in d if v < 0))


def test_signed_rank_chance(spark):
    """Against all signs written out, against the approximation, and through the operator."""
    import itertools

    for n in (6, 7, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4):
            want = min(1.0, 2 * sum(x <= w for x in sums) / 2**n)
            assert voxels.signed_rank_chance(n, w, 0, True) == pytest.approx(want)
    assert voxels.signed_rank_chance(50, 400.0, 0, True) == pytest.approx(voxels.signed_rank_chance(50, 400.0, 0, False), abs=0.01)
    rows = [("a", float(i), 0.0) for i in range(1, 9)] + [("b", float(i % 3), 1.0) for i in range(30)] + [("c", 1.0, 0.0)] * 5 + [("d", 1.0, 1.0)] * 9 + [("a", None, 1.0)]
    got = {r["k"]: (r["n"], r["w"], r["p"]) for r in voxels.signed_rank(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["a"] == (8, 0.0, pytest.approx(2 / 2**8)) and got["c"] == (5, None, None) and got["d"] == (9, None, None)
    assert got["b"][2] == pytest.approx(1.0)


def test_absent_structures_and_summaries(spark):
    schema = "case int, label int, x int, y int, z int"
    a = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 1, 0, 0), (2, 2, 0, 0, 0)], schema)
    b = spark.createDataFrame([(1, 1, 0, 0, 0), (2, 1, 5, 5, 5)], schema)
    scores = voxels.score_cases(a, b, ["case"], (1.0, 1.0, 1.0), labels=[1, 2, 3])
    got = {(r["case"], r["label"]): (r["voxels_a"], r["voxels_b"], r["dice"]) for r in scores.collect()}
    assert got == {(1, 1): (2, 1, pytest.approx(2 / 3)), (1, 2): (0, 0, None), (1, 3): (0, 0, None), (2, 1): (0, 1, 0.0), (2, 2): (1, 0, 0.0), (2, 3): (0, 0, None)}
    per = {r["case"]: (r["mean_dice"], r["n_present"], r["n_classes"]) for r in voxels.case_summary(scores, ["case"]).collect()}
    assert per == {1: (pytest.approx(2 / 3), 1, 3), 2: (0.0, 1, 3)}
    report = [(r["label"], r["n_cases_present"], r["n_cases"]) for r in voxels.structure_report(scores).orderBy("place").collect()]
    assert report == [(2, 0, 2), (1, 2, 2), (3, 0, 2)]
    sizes = lambda x: spark.createDataFrame([(1, [4, 4, x])], "case int, size array<int>")
    assert voxels.shape_mismatches(sizes(4), sizes(5), "case").count() == 1 and voxels.shape_mismatches(sizes(4), sizes(4), "case").count() == 0


def test_masks_take_the_corrected_affine(spark):
    import numpy as np

    tilt = np.array([[0.9, 0.02, 0.0], [-0.01, 0.8, 0.0], [0.0, 0.0, 2.0]])
    rows = [(1, np.column_stack([tilt, [5.0, 6.0, 7.0]]).ravel().tolist()), (2, [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0])]
    volumes = spark.createDataFrame(rows, "case int, affine array<double>")
    masks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case int, mask string")
    got = {(r["case"], r["mask"]): (r["corrected"], np.array(r["affine"]).reshape(3, 4)) for r in voxels.corrected_masks(masks, volumes, "case").collect()}
    assert got[1, "a"][0] and not got[2, "a"][0] and (got[1, "a"][1] == got[1, "b"][1]).all()
    m = got[1, "a"][1]
    unit = m[:, :3] / np.linalg.norm(m[:, :3], axis=0)
    assert np.abs(unit.T @ unit - np.eye(3)).max() < 1e-9 and m[:, 3].tolist() == [5.0, 6.0, 7.0]
    assert np.allclose(np.linalg.norm(m[:, :3], axis=0), np.linalg.norm(tilt, axis=0))
