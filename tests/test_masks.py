import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import bricks, distances, voxels


def rows(spark, mask, case=0, label=1, origin=(0, 0, 0)):
    return spark.createDataFrame([(case, label, *map(int, p + np.array(origin))) for p in np.argwhere(mask)], "s int, label int, x int, y int, z int")


def plain_surface(m):
    p = np.pad(m, 1)
    inner = p[1:-1, 1:-1, 1:-1].copy()
    for axis in range(3):
        for d in (-1, 1):
            inner &= np.roll(p, d, axis)[1:-1, 1:-1, 1:-1]
    return m & ~inner


def plain_distances(a, b, spacing):
    p, q = (np.argwhere(m) * spacing for m in (a, b))
    return np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).min(axis=1)


@pytest.mark.parametrize("short", [0, 128])
@pytest.mark.parametrize("seed, step", [(1, 1.0), (2, 0.37), (3, 2.5)])
def test_envelope_is_the_minimum(monkeypatch, seed, step, short):
    monkeypatch.setattr(distances, "SHORT", short)
    rng = np.random.default_rng(seed)
    for share in (0.05, 0.5, 1.0):
        h = np.where(rng.random((40, 31)) < share, rng.choice([0.0, 1.0, 4.0, 50.0, 1e4], (40, 31)), np.inf)
        i = np.arange(31)
        want = (h[:, None, :] + (step * (i[:, None] - i[None])) ** 2).min(axis=2)
        assert np.allclose(distances.envelope(h, step), want, rtol=1e-12)


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.4, 0.7, 3.0), (5.0, 0.1, 0.3)])
@pytest.mark.parametrize("short", [0, 128])
def test_transform_equals_brute_force(monkeypatch, spacing, short):
    monkeypatch.setattr(distances, "SHORT", short)
    rng = np.random.default_rng(4)
    for share in (0.003, 0.1, 0.7):
        m = rng.random((17, 11, 9)) < share
        m[3, 2, 1] = True
        found = distances.transform(np.argwhere(m), m.shape, spacing)
        assert np.allclose(found.ravel(), plain_distances(np.ones_like(m), m, spacing))


def test_packing_and_surfaces(spark):
    rng = np.random.default_rng(1)
    for share, origin in ((0.7, (0, 0, 0)), (0.97, (-7, 3, -130)), (0.05, (5, -4, 2))):
        m = rng.random((9, 13, 6)) < share
        packed = bricks.packed(rows(spark, m, origin=origin).unionByName(rows(spark, m, origin=origin)), ["s"])
        at = lambda df: {(r["x"], r["y"], r["z"]) for r in df.collect()}
        move = lambda m, o=origin: {tuple(map(int, q + np.array(o))) for q in np.argwhere(m)}
        assert at(bricks.unpacked(packed)) == move(m)
        assert at(bricks.unpacked(bricks.surface(packed, ["s"]))) == move(plain_surface(m))
        assert bricks.counts(packed, ["s"]).first()["n"] == m.sum()


def test_volume_bricks_equal_packed_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (7, 9, 5)).astype(np.uint8)
    want = set()
    for k in (1, 2, 3):
        want |= {tuple(r) for r in bricks.packed(rows(spark, v == k, label=k), ["label"]).collect()}
    assert {tuple(map(int, r)) for r in bricks.volume_bricks(v).itertuples(index=False)} == want
    assert len(bricks.volume_bricks(np.zeros((3, 3, 3), np.uint8))) == 0


def test_far_fewer_rows_than_voxels(spark):
    m = np.add.outer(np.add.outer((np.arange(40) - 20) ** 2, (np.arange(40) - 20) ** 2), (np.arange(40) - 20) ** 2) <= 19**2
    assert 20 * bricks.packed(rows(spark, m), ["s"]).count() < m.sum()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_on_random_masks(spark, seed):
    rng = np.random.default_rng(seed)
    spacing = tuple(rng.choice([0.3, 0.9, 1.0, 2.7], 3))
    sides = []
    for _ in range(2):
        m = np.zeros((50, 40, 30), bool)  # over several tiles and slabs
        for _ in range(3):
            x, y, z = rng.integers(0, 20, 3)
            m[x : x + rng.integers(1, 25), y : y + rng.integers(1, 20), z : z + rng.integers(1, 10)] = True
        sides.append(m)
    a, b = (plain_surface(m) for m in sides)
    d, e = plain_distances(a, b, spacing), plain_distances(b, a, spacing)
    r = voxels.score_cases(rows(spark, sides[0], origin=(-9, 4, -3)), rows(spark, sides[1], origin=(-9, 4, -3)), ["s"], spacing, 1.1).first()
    assert r["nsd"] == pytest.approx(((d <= 1.1).sum() + (e <= 1.1).sum()) / (len(d) + len(e)))
    assert r["hd95"] == pytest.approx(max(np.percentile(d, 95), np.percentile(e, 95)))
    assert r["dice"] == pytest.approx(2 * (sides[0] & sides[1]).sum() / (sides[0].sum() + sides[1].sum()))


def test_null_keys_and_one_side(spark):
    m = np.ones((2, 2, 2), bool)
    a = rows(spark, m).withColumn("s", F.lit(None).cast("int"))
    r = voxels.score_cases(a, a, ["s"], (1.0, 1.0, 1.0)).collect()
    assert [(x["s"], x["dice"], x["nsd"], x["hd95"]) for x in r] == [(None, 1.0, 1.0, 0.0)]
    r = voxels.score_cases(a, a.where("false"), ["s"], (1.0, 1.0, 1.0)).first()
    assert (r["dice"], r["nsd"], r["hd95"]) == (0.0, 0.0, float("inf"))


def ball(spark, center, radius, shape):
    """Bricks of a ball, made where they are used."""
    cell = [F.floor((F.col("id") / k) % n).cast("bigint") for k, n in ((1, shape[0] // 4), (shape[0] // 4, shape[1] // 4), (shape[0] * shape[1] // 16, shape[2] // 4))]
    grid = spark.range(int(np.prod(shape)) // 64).select(*[c.alias(b) for c, b in zip(cell, bricks.BRICK, strict=True)])
    inside = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: sum((4 * F.col(b) + F.shiftright(p, 2 * k).bitwiseAND(3) - c) ** 2 for k, (b, c) in enumerate(zip(bricks.BRICK, center, strict=True))) <= radius**2)
    near = sum(F.greatest(F.lit(0), F.abs(4 * F.col(b) + 1.5 - c) - 2) ** 2 for b, c in zip(bricks.BRICK, center, strict=True)) <= radius**2
    bits = F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, p: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p)))
    return grid.where(near).select(F.lit(0).alias("s"), F.lit(1).alias("label"), *bricks.BRICK, bits.alias("bits")).where("bits != 0")


def test_large_balls(spark):
    """A ball of 0.9 million voxels against one moved by (3, 0, 4) voxels: the farthest surfaces are that far apart."""
    began = time.time()
    a, b = ball(spark, (80, 80, 60), 59.5, (160, 160, 128)), ball(spark, (83, 80, 64), 59.5, (160, 160, 128))
    r = voxels.score_cases(a, b, ["s"], (1.0, 1.0, 1.0), 1.5).first()
    assert r["voxels_a"] == r["voxels_b"] > 850_000
    assert 4 < r["hd95"] <= 5 and 0.2 < r["nsd"] < 0.6 and 0.85 < r["dice"] < 0.95
    assert time.time() - began < 120


def test_overlaps_and_what_is_lost(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((6, 5, 7)) < p for p in (0.5, 0.5, 0.3, 0.8)]
    claims = None
    for i, m in enumerate(masks, 1):
        part = bricks.packed(rows(spark, m, label=i), ["s", "label"])
        claims = part if claims is None else claims.unionByName(part)
    sizes = [(int(m.sum()), i) for i, m in enumerate(masks, 1)]
    for policy, order in (("smaller_wins", sorted(sizes)), ("label_order", [(0, i) for i in (4, 3, 2, 1)])):
        want = np.zeros((6, 5, 7), int)
        for _, i in reversed(order):
            want[masks[i - 1]] = i
        found = bricks.merged(claims, ["s"], policy)
        assert all(want[r["x"], r["y"], r["z"]] == r["label"] for r in bricks.unpacked(found.drop("lost")).collect())
        assert found.select(F.sum(F.bit_count("bits"))).first()[0] == (want > 0).sum()
        assert found.select(F.sum(F.bit_count("lost"))).first()[0] == sum(m.sum() for m in masks) - (want > 0).sum()
    with pytest.raises(ValueError):
        bricks.merged(claims, ["s"], "larger_wins")


def test_remap_reports_what_it_drops(spark):
    v = np.zeros((5, 5, 5), int)
    v[0], v[1, 0], v[2, 0, 0], v[3, 0, :2] = 1, 5, 9, 40
    claims = None
    for k in (1, 5, 9, 40):
        part = bricks.packed(rows(spark, v == k, label=k), ["s", "label"])
        claims = part if claims is None else claims.unionByName(part)
    known, report = bricks.remapped(claims, ["s"], {1: 7, 5: 7, 2: 3, 6: 1})
    r = report.first()
    assert [tuple(u) for u in r["unmapped"]] == [(9, 1), (40, 2)] and r["missing"] == [1, 3]
    assert {(x["label"], x["n"]) for x in bricks.counts(known, ["label"]).collect()} == {(7, 30)}
    known, report = bricks.remapped(claims, ["s"], {})
    assert known.count() == 0 and report.first()["missing"] == [] and len(report.first()["unmapped"]) == 4


def test_scattered_masks_make_no_planes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    sides, spacing = [rng.random((60, 50, 50)) < 0.002 for _ in range(2)], (0.8, 0.8, 1.5)
    a, b = (bricks.surface(bricks.packed(rows(spark, m, origin=(-9, 4, -3)), ["s"]), ["s"]) for m in sides)
    of = lambda r: (r["n"], pytest.approx(r["nsd"]), pytest.approx(r["hd95"]))
    d, e = plain_distances(*sides, spacing), plain_distances(*sides[::-1], spacing)
    want = (len(d) + len(e), ((d <= 3).sum() + (e <= 3).sum()) / (len(d) + len(e)), max(np.percentile(d, 95), np.percentile(e, 95)))
    monkeypatch.setattr(distances, "HELD", 1000)
    with monkeypatch.context() as m:
        m.setattr(distances, "PAIRS", 0)
        planes = distances.surface_scores(a, b, ["s"], spacing, 3).first()
    monkeypatch.setattr(distances, "distances", None)
    assert want == of(distances.surface_scores(a, b, ["s"], spacing, 3).first()) and want == of(planes)
