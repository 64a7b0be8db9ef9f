"""A batch source of label volumes: headers or packed masks of NIfTI and NRRD files, a partition a file.

What is read follows from the columns asked for: without those of the voxels, only a file's beginning is
fetched. Filters on the path are applied to the listing, before any file is opened.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.operators.bricks import BRICK, volume_bricks
from voxloom.sources import nrrd, volumes

HEADER = "path string, kind string, size array<int>, spacing array<double>, origin array<double>, affine array<double>"
VOXELS = "label int, bx bigint, by bigint, bz bigint, bits bigint"
#: Bytes of a file that hold its header; an NRRD header that is longer is read on.
BEGINNING = 4096


@dataclass
class Volume(InputPartition):
    path: str


def kind_of(path: str) -> str | None:
    return next((k for k in ("nrrd", "nii.gz", "nii") if path.lower().endswith(f".{k}")), None)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def beginning(store: fs.FileSystem, path: str, kind: str) -> tuple[list[int], np.ndarray, list[float]]:
    """(size, affine, spacing); fetches no more of the file than its header needs."""
    with store.open_input_file(path) as f:
        content = f.read(BEGINNING)
        if kind != "nrrd":
            return volumes.head(content)
        while not re.search(rb"\r?\n\r?\n", content) and (more := f.read(BEGINNING)):
            content += more
        return nrrd.head(content)


class VolumeReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, glob: str | None):
        self.uri, self.names, self.glob = uri, schema.fieldNames(), glob
        self.fields = schema
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}.get(type(f))
            if known and f.attribute == ("path",):
                self.tests.append((known, f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        test = {"is": lambda v: path == v, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith, "has": lambda v: v in path}
        return kind_of(path) is not None and (not self.glob or fnmatch.fnmatch(path, self.glob)) and all(test[k](v) for k, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.uri)
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [Volume(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.size and self._wanted(f.path)]

    def read(self, partition: Volume) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.uri)
        kind = kind_of(partition.path)
        schema = to_arrow_schema(self.fields)
        if set(self.names) & {"label", *BRICK, "bits"}:
            with store.open_input_file(partition.path) as f:
                values, affine, spacing = (nrrd if kind == "nrrd" else volumes).parse(f.read())
            size, rows = list(values.shape), volume_bricks(values)
        else:
            (size, affine, spacing), rows = beginning(store, partition.path, kind), None
        n = 1 if rows is None else len(rows)
        head = {"path": partition.path, "kind": kind, "size": size, "spacing": spacing, "origin": affine[:3, 3].tolist(), "affine": affine[:3].ravel().tolist()}
        for low in range(0, n, 10_000):
            count = min(10_000, n - low)
            cols = [pa.array([head[c]] * count, schema.field(c).type) if c in head else pa.array(rows[c].to_numpy()[low : low + count], schema.field(c).type) for c in self.names]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


class Volumes(DataSource):
    """Format label_volumes; option path: a file or folder; option glob: only paths that match.

    The default columns are the header's; `.schema(...)` picks others of HEADER and VOXELS. With columns of VOXELS
    there is a row for each brick of each label (none for an empty volume), otherwise one a file.
    """

    @classmethod
    def name(cls) -> str:
        return "label_volumes"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(self.options["path"], schema, self.options.get("glob"))


def register(spark: SparkSession) -> None:
    """Makes the format known; filters are handed to Python sources in a session that allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Volumes)
