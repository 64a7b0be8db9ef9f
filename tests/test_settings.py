from pyspark.sql import functions as F

from voxloom.sources import listing, reports, volumes

# Names of a case's files.
IMAGES = ["ct.nii.gz", "image.nii.gz"]
REGIONS = ["heart", "heart_myocardium", "heart_atrium_left"]
SEEDS = ["coronary_arteries", "coronary_artery"]
SUFFIXES = [".nii.gz", ".nii", ".nrrd"]


def test_pool(spark):
    paths = [
        "s1/ct.nii.gz", "s1/image.nii.gz", "s1/segmentations/heart_myocardium.nii.gz", "s1/segmentations/heart.nrrd", "s1/segmentations/heart.nii",
        "s2/image.nii.gz", "s2/segmentations/liver.nii.gz", "s2/segmentations/coronary_artery.nii",
        "s3/segmentations/heart.nii.gz", "s4/ct.nii.gz", "s4/deeper/segmentations/heart.nii.gz", "s5/ct.nii.gz", "s5/heart.nii.gz", "s5/segmentations/heart_atrium_left.nii.gz", "ct.nii.gz",
    ]
    files = spark.createDataFrame([(f"file:/data/pool/{p}",) for p in paths], "path string")
    gold = spark.createDataFrame([(f"file:/data/gold/{p}",) for p in ("s1.nrrd", "s1.nii.gz", "s5.nii", "s9.nii", "in/s2.nii", "s2.txt")], "path string")
    args = (files, "/data/pool", IMAGES, REGIONS, SEEDS, SUFFIXES)
    short = lambda df: {r["name"]: tuple(x and x.split("/", 3)[3] for x in tuple(r)[1:]) for r in df.collect()}
    every = short(listing.pool_cases(*args, gold, "/data/gold/", with_region=False))
    assert every == {
        "s1": ("s1/ct.nii.gz", "s1/segmentations/heart.nii", None, "s1.nii.gz"),
        "s2": ("s2/image.nii.gz", None, "s2/segmentations/coronary_artery.nii", None),
        "s4": ("s4/ct.nii.gz", None, None, None),
        "s5": ("s5/ct.nii.gz", "s5/segmentations/heart_atrium_left.nii.gz", None, "s5.nii"),
    }
    assert set(short(listing.pool_cases(*args, gold, "/data/gold"))) == {"s1", "s5"}
    assert all(r["gold"] is None for r in listing.pool_cases(*args).collect())
    assert tuple(listing.pool_summary(listing.pool_cases(*args, gold, "/data/gold", with_region=False)).first()) == (4, 2, 2, 1, 2)
    assert listing.pool_cases(files.where("false"), *args[1:], gold, "/data/gold").collect() == []


def test_attribution_and_series(spark, tmp_path):
    rows = [("b", "there", "CC BY 3.0", "CC BY 4.0", "veins", "experts"), ("a", "here", "CC0", "", None, "model"), ("c", None, "CC0", "CC0", "x", "y")]
    collections = spark.createDataFrame(rows, "id string, source string, license string, label_license string, labels string, truth string")
    got = {r["name"]: bytes(r["content"]).decode() for r in reports.attributions(collections, "2024-05-06").collect()}
    assert got["b/ATTRIBUTION.txt"] == "b\nSource: there\nLicence: CC BY 3.0 + CC BY 4.0\nLabels: veins\nProvenance: experts\nRetrieved: 2024-05-06\n"
    assert "Licence: CC0\nLabels: \n" in got["a/ATTRIBUTION.txt"] and "Licence: CC0\n" in got["c/ATTRIBUTION.txt"]
    series = spark.createDataFrame([("a", "p2", "CT", "u1"), ("a", "p1", "SEG", "u3"), ("a", "p1", "CT", "u2"), ("b", "p", "CT", "u4")], "id string, patient string, modality string, uuid string")
    volumes.register(spark)
    reports.series_files(series).write.format("whole_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/a/series.tsv").read_text() == "patient\tmodality\tseries_uuid\np1\tCT\tu2\np1\tSEG\tu3\np2\tCT\tu1\n"


GOOD = "dataset_id: 710\ndataset_name: Tree\nlabel_set: tree\nspacing: [0.5, 0.5, 1]\nmax_spacing_mm: 2\nepochs: 50\nfolds: [0, 2]\n"


def test_tasks(spark, tmp_path):
    files = {
        "Dataset710_Tree": GOOD, "Dataset007_Bones": "dataset_id: 7\ndataset_name: Bones\nlabel_set: bones\nspacing: native\n", "Dataset701_Null": "dataset_id: 701\ndataset_name: Null\nlabel_set: n\nspacing: null\nfolds:\n",
        "Dataset702_Bad": GOOD.replace("[0.5, 0.5, 1]", "[1, 2]"), "Dataset703_Less": "dataset_id: 1\n", "Dataset704_No": "- 1", "Dataset705_Broken": "a: [", "Dataset706_Text": GOOD.replace("710", "x"),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.yaml").write_text(content)
    found = reports.tasks(spark, str(tmp_path / "*.yaml"))
    rows = {r["file"]: r for r in found.collect()}
    assert tuple(rows["Dataset710_Tree"])[1:] == (710, "Tree", "tree", [0.5, 0.5, 1.0], 2.0, "3d_fullres", "nnUNetTrainer_segtrain", "nnUNetPlans", 50, [0, 2], None)
    assert rows["Dataset007_Bones"]["spacing"] is None and rows["Dataset007_Bones"]["epochs"] == 1000 and rows["Dataset701_Null"]["folds"] == [0]
    assert {k: r["problem"] for k, r in rows.items() if r["problem"]} == {
        "Dataset702_Bad": "spacing must be three numbers or native", "Dataset703_Less": "missing dataset_name", "Dataset704_No": "no mapping", "Dataset705_Broken": "not YAML",
        "Dataset706_Text": "invalid literal for int() with base 10: 'x'",
    }
    by = lambda ref: [r["file"] for r in reports.task_by(found, ref).collect()]
    assert by("710") == by("tree") == by("Dataset710_Tree") == ["Dataset710_Tree"] and by("7") == by("007") == ["Dataset007_Bones"] and by("71") == by("") == []


def test_dataset_settings(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("root: /data\nsplits: {val: 0.1, seeds: [1, 2]}\nempty: {}\nlast:\n  deep: {on: true, none: }\n")
    (tmp_path / "bad.yaml").write_text("[1")
    got = {r["key"]: r["value"] for r in reports.dataset_settings(spark, str(tmp_path / "*.yaml")).where(F.col("file") == "d").collect()}
    assert got == {"root": '"/data"', "splits.val": "0.1", "splits.seeds": "[1, 2]", "empty": "{}", "last.deep.True": "true", "last.deep.none": "null"}
    assert reports.dataset_settings(spark, str(tmp_path / "bad.yaml")).count() == 0
