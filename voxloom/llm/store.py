"""Cutting lineage with tables written to the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow

from pyspark.sql import DataFrame, SparkSession

from voxloom.session import shared_dir


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Deletes a table from written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """Whole documents go to Python in batches of at most so many rows and bytes (or one row), which bounds a worker's memory.

    Spark reads these settings when a query is planned, so they stay for the session's later queries.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def trimmed() -> None:
    """Gives the memory of a finished task back to the system: its worker process outlives it, often idle."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
