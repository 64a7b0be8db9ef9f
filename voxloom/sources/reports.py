"""Sinks of reports and logs, label sets from YAML, folds as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A report with a header, a file per partition."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Events appended as JSON lines; Spark's commit makes a batch visible as a whole."""
    df.write.mode("append").json(path)


def folds_as_json(members: DataFrame, key: str) -> DataFrame:
    """(fold, json): {"train": [...], "val": [...]} with sorted ids, a row a fold."""
    lists = members.groupBy("fold").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col(key)))).alias(r) for r in ("train", "val")]
    )
    return lists.select("fold", F.to_json(F.struct("train", "val")).alias("json"))


def folds_from_json(rows: DataFrame, key_type: str = "string") -> DataFrame:
    """(fold, role, key) of rows (fold, json)."""
    parsed = rows.select("fold", F.from_json("json", f"train array<{key_type}>, val array<{key_type}>").alias("j"))
    side = lambda r: parsed.select("fold", F.lit(r).alias("role"), F.explode(f"j.{r}").alias("key"))
    return side("train").unionByName(side("val"))


def label_sets(spark: SparkSession, paths: str) -> DataFrame:
    """(label_set, structure, label, source_value) of YAML files with a `labels` and perhaps a `source_values` mapping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for path, content in zip(files["path"], files["content"], strict=True):
                spec = yaml.safe_load(content) or {}
                source = spec.get("source_values") or {}
                name = spec.get("name") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(name, s, int(i), source.get(s)) for s, i in (spec.get("labels") or {}).items()]
            yield pd.DataFrame(rows, columns=["label_set", "structure", "label", "source_value"]).astype({"label": "Int32", "source_value": "Int32"})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "label_set string, structure string, label int, source_value int")


def label_files(sets: DataFrame) -> DataFrame:
    """(name, content): a YAML file of each label set (label_set, structure, label, source_value), as label_sets reads them; structures by label.

    For the sink whole_files. Names of structures are quoted; a set has a few hundred at most.
    """
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    entries = F.array_sort(F.collect_list(F.struct("label", "structure", "source_value")))
    per = sets.groupBy("label_set").agg(entries.alias("e"))
    line = lambda c: lambda x: F.concat(F.lit("  "), quoted(x["structure"]), F.lit(": "), x[c].cast("string"), F.lit("\n"))
    labels = F.array_join(F.transform("e", line("label")), "")
    given = F.filter("e", lambda x: x["source_value"].isNotNull())
    source = F.when(F.size(given) > 0, F.concat(F.lit("source_values:\n"), F.array_join(F.transform(given, line("source_value")), ""))).otherwise("")
    content = F.concat(F.lit("name: "), quoted(F.col("label_set")), F.lit("\nlabels:\n"), labels, source)
    return per.select(F.concat("label_set", F.lit(".yaml")).alias("name"), F.encode(content, "UTF-8").alias("content"))


def combined_license(image: Column, label: Column) -> Column:
    """Both licences where the labels have one of their own, else the images'."""
    own = F.coalesce(F.trim(label), F.lit(""))
    return F.when((own != "") & (own != image), F.concat(image, F.lit(" + "), own)).otherwise(image)


def attributions(collections: DataFrame, retrieved: str) -> DataFrame:
    """(name, content): <id>/ATTRIBUTION.txt for each collection (id, source, license, label_license, labels, truth), with both licences where they differ.

    For the sink whole_files. Null texts are written as nothing.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = [
        F.col("id"), F.concat(F.lit("Source: "), text("source")), F.concat(F.lit("Licence: "), F.coalesce(combined_license(F.col("license"), F.col("label_license")), F.lit(""))),
        F.concat(F.lit("Labels: "), text("labels")), F.concat(F.lit("Provenance: "), text("truth")), F.lit(f"Retrieved: {retrieved}"), F.lit(""),
    ]
    return collections.select(F.concat("id", F.lit("/ATTRIBUTION.txt")).alias("name"), F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("content"))


def series_files(series: DataFrame) -> DataFrame:
    """(name, content): <id>/series.tsv for each collection's series (id, patient, modality, uuid), by patient and modality, ties by uuid.

    A collection's list is one file, so it is gathered; collections are spread. For the sink whole_files.
    """
    lined = series.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("patient", "modality", "uuid"))).alias("s"))
    rows = F.transform("s", lambda x: F.concat_ws("\t", x["patient"], x["modality"], x["uuid"]))
    content = F.concat(F.array_join(F.concat(F.array(F.lit("patient\tmodality\tseries_uuid")), rows), "\n"), F.lit("\n"))
    return lined.select(F.concat("id", F.lit("/series.tsv")).alias("name"), F.encode(content, "UTF-8").alias("content"))


# What a task's settings are where its file does not say.
TASK_DEFAULTS = {"configuration": "3d_fullres", "trainer": "nnUNetTrainer_segtrain", "plans_name": "nnUNetPlans", "epochs": 1000}
TASK = "file string, dataset_id int, dataset_name string, label_set string, spacing array<double>, max_spacing_mm double, configuration string, trainer string, plans_name string, epochs int, folds array<int>, problem string"
REQUIRED = ("dataset_id", "dataset_name", "label_set", "spacing")


def task_settings(name: str, content: bytes) -> tuple:
    """A row of TASK from one file. spacing is null where it is left to the data ('native' or null); problem says why a file cannot be used."""

    def refused(problem: str) -> tuple:
        return (name, *[None] * 10, problem)

    try:
        spec = yaml.safe_load(content)
    except yaml.YAMLError:
        return refused("not YAML")
    if not isinstance(spec, dict):
        return refused("no mapping")
    absent = [k for k in REQUIRED if k not in spec]
    if absent:
        return refused(f"missing {absent[0]}")
    spacing = spec["spacing"]
    if isinstance(spacing, str) and spacing.strip().lower() == "native":
        spacing = None
    try:
        if spacing is not None:
            if not isinstance(spacing, list) or len(spacing) != 3:
                raise ValueError("spacing must be three numbers or native")
            spacing = [float(x) for x in spacing]
        most = spec.get("max_spacing_mm")
        own = [type(v)(spec.get(k, v)) for k, v in TASK_DEFAULTS.items()]
        folds = [int(f) for f in spec.get("folds") or [0]]
        return (name, int(spec["dataset_id"]), str(spec["dataset_name"]), str(spec["label_set"]), spacing, None if most is None else float(most), *own, folds, None)
    except (TypeError, ValueError) as e:
        return refused(str(e))


def tasks(spark: SparkSession, paths: str) -> DataFrame:
    """Rows of TASK from YAML files; those with a `problem` have no settings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [task_settings(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], c) for p, c in zip(files["path"], files["content"], strict=True)]
            out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in TASK.split(", ")])
            yield out.astype({"dataset_id": "Int32", "epochs": "Int32", "max_spacing_mm": "Float64"})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, TASK)


def task_by(found: DataFrame, reference: str) -> DataFrame:
    """Tasks that a reference names: the file, its number (zeros before it or not), or its name without regard to case; the first file of several."""
    number, name = (F.regexp_extract("file", r"^Dataset(\d+)_(.+)$", k) for k in (1, 2))
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    hit = (F.col("file") == reference) | ((number != "") & (bare(number) == bare(F.lit(reference)))) | ((name != "") & (F.lower(name) == reference.lower()))
    return found.where(hit).orderBy("file").limit(1)


def dataset_settings(spark: SparkSession, paths: str) -> DataFrame:
    """(file, key, value) of YAML files of datasets, nested keys joined by dots, values as JSON; files that are no mapping give no rows."""

    def leaves(spec: dict, before: str = "") -> Iterator[tuple[str, str]]:
        for k, v in spec.items():
            if isinstance(v, dict) and v:
                yield from leaves(v, f"{before}{k}.")
            else:
                yield f"{before}{k}", json.dumps(v, default=str)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for path, content in zip(files["path"], files["content"], strict=True):
                try:
                    spec = yaml.safe_load(content)
                except yaml.YAMLError:
                    spec = None
                rows += [(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], k, v) for k, v in (leaves(spec) if isinstance(spec, dict) else ())]
            yield pd.DataFrame(rows, columns=["file", "key", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, key string, value string")
