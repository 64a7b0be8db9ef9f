"""Session factory and table loader shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "voxloom", shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; a running session is reused as it is."""
    return (
        SparkSession.builder.master(master or f"local[{os.cpu_count()}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests), else an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        path = tempfile.mkdtemp(prefix="voxloom-")
        context.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept as Parquet in the shared folder, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
