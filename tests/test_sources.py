import json

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.sources import listing, volumes
from voxloom.streaming import log_reader


def test_index_round_trip_and_problems(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image_id;split;study_type\n a ;train; ct\nb;val;\n;test;x\na;odd;y\n", encoding="utf-8")
    index = listing.read_index(spark, str(tmp_path / "m.csv"))
    assert sorted((r["image_id"], r["study_type"]) for r in index.collect()) == [("a", "ct"), ("a", "y"), ("b", "unknown")]
    assert {(r["problem"], r["value"]) for r in listing.index_problems(index).collect()} == {("duplicate_id", "a"), ("unknown_split", "odd")}
    listing.write_index(index, str(tmp_path / "out"))
    assert listing.read_index(spark, str(tmp_path / "out")).count() == 3


def test_overrides(spark, tmp_path):
    (tmp_path / "o.csv").write_text("case_id,split\nc1,val\nc2,trian\nc1,test\n")
    kept, rejected = listing.read_overrides(spark, str(tmp_path / "o.csv"))
    assert [(r[0], r[1]) for r in kept.collect()] == [("c1", "test")]
    assert [r["line"] for r in rejected.collect()] == ["c2,trian"]
    (tmp_path / "p.csv").write_text("c9;val\n")
    assert [(r[0], r[1]) for r in listing.read_overrides(spark, str(tmp_path / "p.csv"))[0].collect()] == [("c9", "val")]


def test_case_tree(spark, tmp_path):
    for p in ("a/ct.nii.gz", "a/segmentations/heart.nii.gz", "b/image.nii.gz", "b/labels.nii.gz", "c/labels.nii.gz", "d/image.nii.gz", "d/ct.nii.gz"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = {r["case_id"]: (r["image"].rsplit("/", 1)[1], r["label_form"]) for r in listing.cases(listing.files_under(spark, str(tmp_path)), ["ct.nii.gz", "image.nii.gz"], ["labels.nii.gz"]).collect()}
    assert got == {"a": ("ct.nii.gz", "masks"), "b": ("image.nii.gz", "multilabel"), "d": ("ct.nii.gz", "none")}


def test_queue_lines_and_magic(spark):
    lines = spark.createDataFrame([("1|seg-a|R|1:00|2:00|x",), ("2|other|R|1|2|y",), ("short|line",)], "value string")
    assert [r["id"] for r in listing.queued_jobs(lines, "seg").collect()] == ["1"]
    files = spark.createDataFrame([(b"NRRD0004",), (b"\x1f\x8b....",), (b"\0" * 344 + b"n+1\0",), (b"?",)], "c binary")
    assert [r[0] for r in files.select(listing.volume_kind(F.col("c"))).collect()] == ["nrrd", "nii.gz", "nii", None]


def test_manifests_skip_corrupt(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.json").write_text('{"assignmentId": "1", "sizeBytes": 5}')
    (tmp_path / "x/b.json").write_text("{broken")
    assert [r["assignmentId"] for r in listing.manifests(spark, str(tmp_path)).collect()] == ["1"]


def test_batch_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"t": 1, "event": "run_start"}\n\n{bad\n{"t": 2, "event": "strange", "x": [1]}\n{"t": 3, "ev')
    assert [(r["t"], r["event"]) for r in listing.read_log(spark, str(tmp_path)).orderBy("pos").collect()] == [(1.0, "run_start"), (2.0, "strange")]


def test_growing_log_reader(tmp_path, monkeypatch):
    p = tmp_path / "run.jsonl"
    p.write_text('{"t": 1, "event": "epoch"}\n{"t": 2, "eve')
    reader = log_reader.LogReader(str(tmp_path / "*.jsonl"))
    times = lambda start, end: [r[2] for part in reader.partitions(start, end) for r in reader.read(part)]
    first, at = reader.initialOffset(), reader.latestOffset()
    assert times(first, at) == [1.0]
    with p.open("a") as f:
        f.write('nt": "epoch"}\nnonsense\n{"t": 3, "event": "log"}\n')
    after = reader.latestOffset()
    assert times(at, after) == [2.0, 3.0]
    monkeypatch.setattr(log_reader, "CHUNK", 7)
    assert times(at, after) == [2.0, 3.0] and times(first, after) == [1.0, 2.0, 3.0] and times(after, after) == []
    p.write_text('{"t": 9, "event": "run_start"}\n')
    assert times(after, reader.latestOffset()) == [9.0]
    (tmp_path / "two.jsonl").write_text('{"t": 4}\n')
    assert len(reader.partitions({}, reader.latestOffset())) == 2
    p.unlink()
    assert times(first, after) == []


def test_growing_log_as_stream(spark, tmp_path):
    log_reader.register(spark)
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"t": i, "event": "epoch"}) + "\n" for i in range(5)))
    q = spark.readStream.format("growing_log").option("path", str(tmp_path / "*.jsonl")).load().writeStream.format("memory").queryName("grown").start()
    try:
        q.processAllAvailable()
        with (tmp_path / "a.jsonl").open("a") as f:
            f.write('{"t": 5, "event": "run_end"}\n')
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["t"] for r in spark.table("grown").orderBy("pos").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_texts(spark):
    row = spark.range(1).select(
        text.suffix(F.lit("s0004.NII.GZ")).alias("a"), text.case_name(F.lit("/x/y/s1.nii.gz")).alias("b"), text.safe_name(F.lit("../é b?")).alias("c"),
        text.human_bytes(F.lit(1536)).alias("d"), text.duration(F.lit(3700)).alias("e"), text.walltime_text(F.lit(90061)).alias("f"),
        text.ssh_location(F.lit("me@host:/runs/1")).alias("g"), text.ssh_location(F.lit("/local/dir")).alias("h"), text.checkpoint_kind(F.lit("checkpoint_best.pth")).alias("i"),
        text.checksum_matches(F.lit(" AB "), F.lit("ab")).alias("j"), text.checksum_matches(F.lit(""), F.lit("")).alias("k"), text.checksum_matches(F.lit("ab"), F.lit(None)).alias("l"),
    ).first()
    assert tuple(row[c] for c in "abcdef") == (".nii.gz", "s1", "é_b_".strip("._"), "1.5 KB", "1h01m", "1-01:01:01")
    assert (row["g"]["host"], row["g"]["path"], row["h"]["host"], row["i"]) == ("me@host", "/runs/1", None, "best")
    assert (row["j"], row["k"], row["l"]) == (True, True, False)


def test_sizes_stop_at_the_largest_unit(spark, tmp_path):
    n = F.col("n")
    rows = spark.createDataFrame([(5,), (2**31,), (-(2**31),), (2**40,)], "n bigint").select(n, text.human_bytes(n, "MB").alias("mb"), text.human_bytes(n).alias("tb")).collect()
    assert [(r["mb"], r["tb"]) for r in rows] == [("5 B", "5 B"), ("2048.0 MB", "2.0 GB"), ("-2048.0 MB", "-2.0 GB"), ("1048576.0 MB", "1.0 TB")]
    from voxloom.plans import text_queries

    spark.createDataFrame([(4_000_000,)], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    assert text_queries.human_texts(spark, str(tmp_path)).first()["size"] == "1262.7 MB"


def test_label_sets_are_not_expanded(spark):
    from voxloom.functions import records

    rows = [("a", 1, "x", 5), ("a", 2, "y", 6), ("b", 1, "x", 5), ("b", 1, "x", 5), ("c", 1, None, None), ("c", 2, "y", None), ("d", 2, "x", 0), ("e", None, "x", 1), ("e", 1, "y", 1)]
    report = records.label_set_report(spark.createDataFrame(rows, "s string, i int, t string, v int"), "s", "t", "i", "v")
    want = {"a": (2, True, True, True), "b": (2, False, False, False), "c": (2, True, False, True), "d": (1, False, True, False), "e": (2, False, True, False)}
    assert {r[0]: tuple(bool(x) if k else x for k, x in enumerate(r[1:])) for r in report.collect()} == want
    assert "Expand" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_label_sets_and_reports(spark, tmp_path):
    from voxloom.functions import records
    from voxloom.sources import reports

    (tmp_path / "coronary.yaml").write_text("labels:\n  LM: 1\n  LAD: 2\nsource_values:\n  LM: 7\n")
    sets = reports.label_sets(spark, str(tmp_path / "*.yaml"))
    assert {tuple(r) for r in sets.collect()} == {("coronary", "LM", 1, 7), ("coronary", "LAD", 2, None)}
    report = records.label_set_report(sets, "label_set", "structure", "label", "source_value").first()
    assert report["contiguous"] and report["unique_names"] and report["source_injective"]
    reports.write_csv(sets, str(tmp_path / "out"), "\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out")).count() == 2
    events = spark.createDataFrame([(1.0, "epoch")], "t double, event string")
    for _ in range(2):
        reports.append_log(events, str(tmp_path / "log"))
    assert listing.read_log(spark, str(tmp_path / "log")).count() == 2


def test_masks_become_volumes_and_come_back(spark, tmp_path):
    from voxloom.operators import voxels

    rows = spark.createDataFrame([("c1", 1, 0, 0, 0), ("c1", 1, 3, 2, 1), ("c1", 7, 1, 1, 1), ("c2", 2, 2, 2, 2)], "case string, label int, x int, y int, z int")
    masks = voxels.masks_of(rows, "case", [1, 2])
    grid = spark.createDataFrame([(c, [4, 3, 3], [0.5, 0.5, 2.0], [0.5, 0.0, 0.0, 9.0, 0.0, 0.5, 0.0, 8.0, 0.0, 0.0, 2.0, 7.0]) for c in ("c1", "c2")], "case string, size array<int>, spacing array<double>, affine array<double>")
    volumes.register(spark)
    for _ in range(2):
        volumes.volumes(masks, grid, "case").write.format("whole_files").mode("append").option("path", str(tmp_path / "out")).save()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "out"))
    names = {"/".join(r["path"].split("/")[-2:]) for r in files.collect()}
    assert names == {"c1/1.nii.gz", "c1/2.nii.gz", "c2/1.nii.gz", "c2/2.nii.gz"}
    found = {("/".join(r["path"].split("/")[-2:]), r["label"], r["x"], r["y"], r["z"]) for r in volumes.label_rows(files).collect()}
    assert found == {("c1/1.nii.gz", 1, 0, 0, 0), ("c1/1.nii.gz", 1, 3, 2, 1), ("c2/2.nii.gz", 1, 2, 2, 2)}
    g = volumes.geometry(files).first()
    assert (list(g["size"]), list(g["spacing"]), list(g["origin"])) == ([4, 3, 3], [0.5, 0.5, 2.0], [9.0, 8.0, 7.0])
    with pytest.raises(Exception, match="leads out"):
        spark.createDataFrame([("../x", b"")], "name string, content binary").write.format("whole_files").mode("append").option("path", str(tmp_path / "out")).save()


def test_label_sets_go_out_and_come_back(spark, tmp_path):
    from voxloom.sources import reports

    rows = {("heart", "it's", 2, None), ("heart", "LM: left", 1, 7), ("lung", "lobe", 1, 3)}
    volumes.register(spark)
    sets = spark.createDataFrame(sorted(rows, key=str), "label_set string, structure string, label int, source_value int")
    reports.label_files(sets).write.format("whole_files").mode("append").option("path", str(tmp_path)).save()
    assert {tuple(r) for r in reports.label_sets(spark, str(tmp_path / "*.yaml")).collect()} == rows


def test_leases_run_out_in_a_stream(spark, tmp_path):
    """A lease too old, one without heartbeats, one that was closed in time, and one that is still good."""
    from datetime import datetime, timedelta, timezone

    from voxloom.streaming import leases

    start, day = datetime(2024, 1, 1, tzinfo=timezone.utc), timedelta(days=1)
    batches = [
        [(1, 0, "assign"), (2, 0, "assign"), (3, 0, "assign"), (2, 0.5, "heartbeat"), (3, 1, "submit"), (9, 1, "heartbeat")],
        [(4, 5, "assign"), (1, 5, "heartbeat")],
        [(4, 6, "heartbeat"), (5, 7.5, "assign")],
        [(5, 7.6, "heartbeat")],
    ]
    (tmp_path / "in").mkdir()
    schema = "assignment bigint, ts timestamp, event string"
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = leases.expiries(log).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, rows in enumerate(batches):
            lines = [json.dumps({"assignment": a, "ts": (start + d * day).isoformat(), "event": e}) for a, d, e in rows]
            (tmp_path / "in" / f"b{i}.json").write_text("\n".join(lines))
            q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["assignment"], round((r["expired_at"] - start.timestamp()) / 86400, 3), r["reason"]) for r in spark.table("expired").collect()}
    assert got == {(2, 3.5, "no heartbeat for 72 hours"), (1, 7.0, "lease of 7 days expired")}


def test_files_settle(spark):
    from voxloom.operators import runs

    looks = [("a", 1, 10, 1), ("a", 2, 20, 1), ("a", 3, 20, 1), ("a", 4, 20, 1), ("a", 5, 5, 2), ("a", 6, 5, 2), ("b", 1, 7, 1), ("b", 2, 7, 2)]
    got = runs.settled_files(spark.createDataFrame(looks, "path string, at int, size int, changed int"), "path", ["at"], "size", "changed").collect()
    assert {tuple(r) for r in got} == {("a", 1, 3), ("a", 2, 6)}
