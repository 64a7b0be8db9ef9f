import gzip
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import tables
from voxloom.operators import bricks, voxels
from voxloom.sources import archives, nrrd, volume_reader, volumes

SPACING = (0.5, 1.25, 3.0)
AFFINE = np.array([[0.0, -1.25, 0, 7], [0.5, 0, 0, -3.5], [0, 0, 3.0, 11], [0, 0, 0, 1]])


def labels(seed=0):
    rng = np.random.default_rng(seed)
    v = np.zeros((9, 11, 6), np.uint8)
    for k in (1, 2, 3):
        x, y, z = rng.integers(0, 5, 3) * [1, 1, 0]
        v[x : x + 4, y : y + 5, z : z + 3] = k
    return v


def nifti(values, packed=True):
    content = volumes.header(values.shape, SPACING, AFFINE) + values.tobytes(order="F")
    return gzip.compress(content, mtime=0) if packed else content


@pytest.fixture
def folder(tmp_path):
    """One volume in four files, an empty volume, and files that are no volumes."""
    v = labels()
    (tmp_path / "a").mkdir()
    files = {
        "a/one.nii.gz": nifti(v), "a/two.nii": nifti(v, packed=False), "three.nrrd": nrrd.written(v, AFFINE), "four.nrrd": nrrd.written(v, AFFINE, packed=False),
        "none.nii.gz": nifti(np.zeros((3, 4, 5), np.uint8)), "empty.nrrd": b"", "note.txt": b"NRRD",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def read(spark, folder, schema, **options):
    volume_reader.register(spark)
    return spark.read.format("label_volumes").options(**options).schema(schema).load(str(folder))


def test_headers(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read(spark, folder, volume_reader.HEADER).collect()}
    assert set(rows) == {"one.nii.gz", "two.nii", "three.nrrd", "four.nrrd", "none.nii.gz"}
    for name in ("one.nii.gz", "two.nii", "three.nrrd", "four.nrrd"):
        r = rows[name]
        assert r["size"] == [9, 11, 6] and r["kind"] == name.split(".", 1)[1]
        assert np.allclose(r["spacing"], SPACING) and np.allclose(r["affine"], AFFINE[:3].ravel()) and np.allclose(r["origin"], AFFINE[:3, 3])


def test_both_formats_hold_the_same_masks(spark, folder):
    rows = read(spark, folder, "path string, " + volume_reader.VOXELS)
    by = {}
    for r in rows.collect():
        by.setdefault(r["path"].rsplit("/", 1)[1], set()).add(tuple(r)[1:])
    assert len(by) == 4 and len(set(map(frozenset, by.values()))) == 1
    v = labels()
    want = {(k, *map(int, q)) for k in (1, 2, 3) for q in np.argwhere(v == k)}
    assert {tuple(r) for r in bricks.unpacked(rows.where("path LIKE '%three.nrrd'").drop("path")).collect()} == want


def test_scores_of_two_formats(spark, folder):
    rows = read(spark, folder, "path string, " + volume_reader.VOXELS)
    side = lambda name: rows.where(F.col("path").endswith(name)).select(F.lit(0).alias("s"), "label", *bricks.BRICK, "bits")
    spacing = tuple(read(spark, folder, "path string, spacing array<double>").where(F.col("path").endswith("three.nrrd")).first()["spacing"])
    assert spacing == pytest.approx(SPACING)
    for r in voxels.score_cases(side("/one.nii.gz"), side("three.nrrd"), ["s"], spacing).collect():
        assert (r["dice"], r["nsd"], r["hd95"]) == (1.0, 1.0, 0.0)


def test_headers_read_the_beginning_only(spark, folder):
    for name in ("cut.nrrd", "cut.nii"):
        whole = (folder / ("four.nrrd" if name.endswith("nrrd") else "a/two.nii")).read_bytes()
        (folder / name).write_bytes(whole[: len(whole) - 500])  # voxels are missing
    paths = [r["path"] for r in read(spark, folder, "path string, size array<int>").where(F.col("path").contains("/cut")).collect()]
    assert len(paths) == 2
    with pytest.raises(Exception, match="buffer"):
        read(spark, folder, "path string, bits bigint").where(F.col("path").contains("/cut")).collect()


def test_filters_and_globs_choose_files(spark, folder):
    (folder / "broken.nrrd").write_bytes(b"NRRD0004\nnothing")  # fails if it is opened
    one = read(spark, folder, "path string, kind string").where(F.col("path").endswith("/one.nii.gz"))
    assert [r["kind"] for r in one.collect()] == ["nii.gz"] and one.rdd.getNumPartitions() == 1
    assert read(spark, folder, "path string", glob="*/a/*").count() == 2
    assert read(spark, folder / "a" / "one.nii.gz", "path string").count() == 1


@pytest.mark.parametrize("change", [lambda b: b.replace(b"space directions", b"thicknesses"), lambda b: b.replace(b"left-posterior-superior", b"LPS"), lambda b: b.replace(b"\n", b"\r\n", 11)])
def test_other_nrrd_headers(change):
    values, affine, _ = nrrd.parse(change(nrrd.written(labels(), AFFINE)))
    assert (values == labels()).all() and (np.allclose(affine, AFFINE) or np.allclose(np.abs(affine[:3, :3]), np.eye(3)))


def test_nrrd_that_cannot_be_read():
    good = nrrd.written(labels(), AFFINE)
    for bad in (good.replace(b"dimension: 3", b"dimension: 4").replace(b"sizes: 9 11 6", b"sizes: 1 9 11 6"), good.replace(b"gzip", b"bzip2"), good.replace(b"endian", b"data file: x\nendian"), b"no"):
        with pytest.raises(ValueError):
            nrrd.parse(bad)


def test_big_endian_and_spacings():
    v = labels().astype("<i2")
    content = nrrd.written(v, np.eye(4), packed=False).replace(b"endian: little", b"endian: big").replace(b"space directions: (-1.0,0.0,0.0) (0.0,-1.0,0.0) (0.0,0.0,1.0)", b"spacings: 0.5 1.25 3")
    start = nrrd.header(content)[1]
    values, _, spacing = nrrd.parse(content[:start] + v.astype(">i2").tobytes(order="F"))
    assert (values == v).all() and spacing == [0.5, 1.25, 3.0]


def test_whole_files_appear_when_the_job_commits(spark, tmp_path):
    volumes.register(spark)
    rows = spark.createDataFrame([("a/x", b"1"), ("b", b"22")], "name string, content binary")
    rows.write.format("whole_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/a/x").read_bytes() == b"1" and (tmp_path / "out/b").read_bytes() == b"22"
    bad = rows.unionByName(spark.createDataFrame([("../out of it", b"")], "name string, content binary"))
    with pytest.raises(Exception, match="leads out"):
        bad.coalesce(1).write.format("whole_files").mode("append").save(str(tmp_path / "second"))
    assert not [f for f in (tmp_path / "second").rglob("*") if f.is_file() and not f.name.endswith(".part")]


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content, method in members:
            z.writestr(name, content, method)


def test_archive_in_many_ranges(spark, tmp_path):
    rng = random.Random(1)
    members = [(f"set/s{i:04d}/m.bin", rng.randbytes(rng.randrange(4000)), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED) for i in range(60)]
    archive(tmp_path / "x.zip", [*members, ("set/empty/", b"", zipfile.ZIP_STORED)])
    archives.register(spark)
    df = spark.read.format("zip_members").option("rangeBytes", 9000).load(str(tmp_path / "x.zip"))
    assert df.rdd.getNumPartitions() > 8
    assert {r["name"]: bytes(r["content"]) for r in df.collect()} == {n: c for n, c, _ in members}
    listed = spark.read.format("zip_members").schema("name string, size bigint").load(str(tmp_path / "x.zip"))
    assert archives.archive_root(listed) == "set/"
    here = spark.createDataFrame([(n, len(c) + (i == 3)) for i, (n, c, _) in enumerate(members[:50])], "name string, size bigint")
    assert {r["name"] for r in archives.missing(listed, here).collect()} == {members[3][0], *[n for n, *_ in members[50:]]}
    archives.unpack(spark, str(tmp_path / "x.zip"), str(tmp_path / "out"), here, 9000)
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()} == {n: c for n, c, _ in [members[3], *members[50:]]}


def test_archives_that_are_refused(spark, tmp_path):
    archives.register(spark)
    load = lambda name: spark.read.format("zip_members").load(str(tmp_path / name)).collect()
    for i, name in enumerate(["../x", "/x", "a/../../x", "C:/x", "..\\x"]):
        archive(tmp_path / f"{i}.zip", [("fine", b"1", 0), (name, b"2", 0)])
        with pytest.raises(Exception, match="leads out"):
            load(f"{i}.zip")
    assert archives.safe("a/..b/c..") and archives.safe("a/b/../c")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x", b"hello hello", zipfile.ZIP_STORED)
    (tmp_path / "bad.zip").write_bytes(buffer.getvalue().replace(b"hello hello", b"hello hullo"))
    with pytest.raises(Exception, match="damaged"):
        load("bad.zip")
    archive(tmp_path / "two.zip", [("a/x", b"", 0), ("b/x", b"", 0)])
    archive(tmp_path / "flat.zip", [("x", b"", 0)])
    for name in ("two.zip", "flat.zip"):
        assert archives.archive_root(spark.read.format("zip_members").load(str(tmp_path / name))) == ""


def test_voxels_of_a_volume_in_sql(spark, folder):
    tables.register(spark)
    spark.read.format("binaryFile").load(str(folder / "*.nrrd")).where("length > 0").createOrReplaceTempView("some_volumes")
    rows = spark.sql("SELECT path, v.* FROM some_volumes, LATERAL volume_voxels(content) v").collect()
    want = {(int(labels()[tuple(q)]), *map(int, q)) for q in np.argwhere(labels())}
    for name in ("three.nrrd", "four.nrrd"):
        assert {tuple(r)[1:] for r in rows if r["path"].endswith(name)} == want
    assert spark.sql("SELECT * FROM volume_voxels(NULL)").count() == 0


def test_submission_problems(spark):
    tables.register(spark)
    rows = [
        (1, ["R", "A", "R"], [5, 20, 4], 60.0),
        (2, ["zz", "A", None, "N", "empty"], [1, 8, 3, 2, 0], 59.5),
        (3, [], [], None),
        (None, ["R"], [None], 100.0),
    ]
    given = spark.createDataFrame(rows, "key long, segments array<string>, voxels array<long>, seconds double")
    got = {}
    for r in spark.sql("SELECT * FROM submission_problems(TABLE(SELECT * FROM {given}), 'R', 'A')", given=given).collect():
        got.setdefault(r["key"], []).append((r["level"], r["code"], r["subject"]))
    missing = ("error", "empty_required_segment", "R")
    assert got == {
        1: [(None, None, None)],
        2: [missing, ("error", "stray_voxels", "A"), ("error", "unexpected_segment", "N"), ("error", "unexpected_segment", "zz"), ("warning", "implausibly_fast", "60")],
        3: [missing, ("warning", "empty_optional_segment", "A")],
        None: [missing, ("warning", "empty_optional_segment", "A")],
    }
    none = spark.sql("SELECT * FROM submission_problems(TABLE(SELECT * FROM {given}), 'R', 'A')", given=given.where("false"))
    assert none.count() == 0


def test_submissions_are_dealt_twice_and_not_joined(spark, tmp_path):
    """Once for the counts and once for the lists; an order without a key has its problems too."""
    from voxloom.plans import annotation_queries

    items = [(k, f, float(q)) for k in (1, 2, None) for f, q in (("A", 30), ("A", 40), ("N", k or 1))]
    spark.createDataFrame(items, "l_orderkey long, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = annotation_queries.submission_problems(spark, str(tmp_path))
    said = "empty_required_segment:R,stray_voxels:A,unexpected_segment:N"
    assert {(r["l_orderkey"], r["problems"]) for r in found.collect()} == {(k, said) for k in (1, 2, None)}
    plan = found.select(F.col("problems"))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 2 and "Join" not in initial and "ArrowEvalPythonUDTF" in initial
