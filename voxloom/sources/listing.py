"""Index files, overrides, case trees, bucket listings, queue listings, archives and volume headers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = ["image_id", "split", "study_type", "institute", "manufacturer"]
SPLITS = ("train", "val", "test")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The dataset index: semicolons, a byte-order mark allowed, values trimmed, blank ids dropped, study_type 'unknown' where blank."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    named = raw.toDF(*[c.strip().lstrip("﻿").strip('"') for c in raw.columns])
    if "image_id" not in named.columns:
        raise ValueError("the index has no image_id column")
    value = lambda c: F.trim(F.col(c)) if c in named.columns else F.lit(None).cast("string")
    rows = named.select(*[value(c).alias(c) for c in INDEX]).where("image_id IS NOT NULL AND image_id != ''")
    return rows.withColumn("study_type", F.coalesce(F.nullif("study_type", F.lit("")), F.lit("unknown")))


def index_problems(index: DataFrame) -> DataFrame:
    """(problem, value, n): duplicate ids and unknown splits."""
    twice = index.groupBy(F.col("image_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1").withColumn("problem", F.lit("duplicate_id"))
    odd = index.where(~F.coalesce("split", F.lit("")).isin(*SPLITS)).groupBy(F.col("split").alias("value")).agg(F.count("*").alias("n"))
    return twice.unionByName(odd.withColumn("problem", F.lit("unknown_split"))).select("problem", "value", "n")


def write_index(rows: DataFrame, path: str) -> None:
    """The index in its fixed column order; in one file per partition."""
    rows.select(*INDEX).write.option("header", True).option("sep", ";").mode("overwrite").csv(path)


def read_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((case_id, split), rejected lines): comma or semicolon, header or none; the last valid line of an id wins.

    Places in the file order the lines: files of overrides are small and read as one row each.
    """
    files = spark.read.option("wholetext", True).text(path)
    lines = files.select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("place", "line"))
    cut = lines.select("place", "line", F.split("line", "[;,]").alias("c")).where("trim(line) != ''")
    parsed = cut.select("place", "line", F.trim(F.get("c", F.lit(0))).alias("case_id"), F.lower(F.trim(F.get("c", F.lit(1)))).alias("split"))
    valid = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)) & (F.col("case_id") != "")
    kept = parsed.where(valid).groupBy("case_id").agg(F.max_by("split", "place").alias("split"))
    header = (F.col("place") == 0) & (F.coalesce(F.col("split"), F.lit("")) == "split")
    return kept, parsed.where(~valid & ~header).select("place", "line")


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under a folder, without their content; empty files are no volumes and are not listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def cases(files: DataFrame, images: list[str], labels: list[str]) -> DataFrame:
    """(case_id, image, labels, label_form) of case folders; the first preferred name wins, folders without an image are left out.

    label_form: multilabel (one volume), masks (a folder of masks), or none.
    """
    found = files.select(F.regexp_extract("path", r"([^/]+)/(?:segmentations/)?[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    rank = lambda names: F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    image = F.when(F.col("name").isin(images), F.try_element_at(rank(images), F.col("name")))
    label = F.when(F.col("name").isin(labels), F.try_element_at(rank(labels), F.col("name")))
    per = found.groupBy("case_id").agg(
        F.min_by("path", image).alias("image"), F.min_by("path", label).alias("labels"), F.bool_or(F.col("path").contains("/segmentations/")).alias("_masks")
    )
    form = F.when(F.col("labels").isNotNull(), "multilabel").when(F.col("_masks"), "masks").otherwise("none")
    return per.where("image IS NOT NULL").withColumn("label_form", form).drop("_masks")


def listed_objects(pages: DataFrame, xml: str) -> DataFrame:
    """(key, size, token) of bucket listings; directory placeholders dropped, the token only where the listing is cut."""
    bare = F.regexp_replace(F.col(xml), r"\sxmlns=(['\"])[^'\"]*\1", "")
    keys, sizes = F.xpath(bare, F.lit("//Contents/Key/text()")), F.xpath(bare, F.lit("//Contents/Size/text()"))
    token = F.when(F.lower(F.xpath_string(bare, F.lit("//IsTruncated"))) == "true", F.xpath_string(bare, F.lit("//NextContinuationToken")))
    rows = pages.select(F.explode(F.arrays_zip(keys.alias("k"), sizes.alias("s"))).alias("o"), token.alias("token"))
    return rows.select(F.col("o.k").alias("key"), F.col("o.s").cast("bigint").alias("size"), "token").where("key NOT LIKE '%/'")


def queued_jobs(lines: DataFrame, prefix: str, line: str = "value") -> DataFrame:
    """(id, name, state, elapsed, limit, reason) from pipe-separated queue listings; short lines and other names are dropped."""
    c = F.split(F.trim(F.col(line)), r"\|")
    rows = lines.where(F.size(c) >= 6).select(*[F.trim(F.get(c, F.lit(i))).alias(n) for i, n in enumerate(("id", "name", "state", "elapsed", "limit", "reason"))])
    return rows.where(F.col("name").startswith(prefix))


def volume_kind(content: Column) -> Column:
    """nrrd, nii, nii.gz or null, by the first bytes (and those at offset 344)."""
    magic = F.hex(F.substring(content, 345, F.lit(4)))
    return (
        F.when(F.hex(F.substring(content, 1, F.lit(4))) == "4E525244", "nrrd")
        .when(F.hex(F.substring(content, 1, F.lit(2))) == "1F8B", "nii.gz")
        .when(magic.isin("6E2B3100", "6E693100"), "nii")
    )


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Cache manifests (one JSON object a file); corrupt ones count as absent."""
    schema = "assignmentId string, caseId string, sizeBytes bigint, attempt int, createdAt double, elapsedSeconds double, submitted boolean"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(root)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, t, event, raw) of JSON-lines logs; blank, half-written and corrupt lines are skipped, unknown kinds kept."""
    lines = spark.read.option("wholetext", False).text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("raw"))
    parsed = lines.where("raw != ''").withColumn("e", F.from_json("raw", "t double, event string"))
    return parsed.where("e IS NOT NULL AND try_parse_json(raw) IS NOT NULL").select("file", "pos", "e.t", "e.event", "raw")


def pool_cases(files: DataFrame, root: str, images: list[str], regions: list[str], seeds: list[str], suffixes: list[str], gold: DataFrame | None = None, gold_root: str = "", with_region: bool = True) -> DataFrame:
    """(name, volume, region, seed, gold) of the case folders right below a root, from listings (path) of the pool and of a second root.

    A case's volume is the first of `images` it has; region and seed are the first of their stems, each with the first of
    the suffixes, among its segmentations; gold is the file of the case's name right below the gold root, kept apart from
    the pool so that no annotator is handed it. Cases without a volume are left out, and with `with_region` those without a
    region. All names are taken as they are written; null columns where there is none.
    """
    base = root.rstrip("/") + "/"
    part = F.split(F.substring(F.col("path"), F.instr("path", base) + F.lit(len(base)), F.length("path")), "/")
    below = files.where(F.instr("path", base) > 0).select("path", part.alias("p"))
    name, n = F.get("p", F.lit(0)), F.size("p")
    place = lambda column, names: F.when(column.isin(names), F.array_position(F.array(*[F.lit(x) for x in names]), column))
    masks = lambda stems: [stem + s for stem in stems for s in suffixes]
    inside = (n == 3) & (F.get("p", F.lit(1)) == "segmentations")
    image = F.when(n == 2, place(F.get("p", F.lit(1)), images))
    region, seed = (F.when(inside, place(F.get("p", F.lit(2)), masks(stems))) for stems in (regions, seeds))
    per = below.groupBy(name.alias("name")).agg(*[F.min_by("path", at).alias(c) for c, at in (("volume", image), ("region", region), ("seed", seed))])
    found = per.where("volume IS NOT NULL")
    if with_region:
        found = found.where("region IS NOT NULL")
    if gold is None:
        return found.withColumn("gold", F.lit(None).cast("string"))
    top = gold_root.rstrip("/") + "/"
    file = F.substring(F.col("path"), F.instr("path", top) + F.lit(len(top)), F.length("path"))
    rows = gold.where(F.instr("path", top) > 0).select("path", file.alias("file")).where("instr(file, '/') = 0")
    ranks = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("s")) for i, s in enumerate(suffixes)]), lambda x: F.col("file").endswith(x["s"]))
    ends = rows.withColumn("e", F.explode(ranks)).select("path", F.substring(F.col("file"), F.lit(1), F.length("file") - F.length("e.s")).alias("name"), "e.at")
    return found.join(ends.groupBy("name").agg(F.min_by("path", "at").alias("gold")), "name", "left")


def pool_summary(every: DataFrame) -> DataFrame:
    """(cases, with_region, without_region, with_seed, with_gold) of pool_cases without the region's filter: what a dry run shows, what is left out included."""
    return every.agg(
        F.count("*").alias("cases"), F.count("region").alias("with_region"), (F.count("*") - F.count("region")).alias("without_region"), F.count("seed").alias("with_seed"), F.count("gold").alias("with_gold")
    )
