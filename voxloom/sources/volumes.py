"""NIfTI volumes as sparse label rows, and label rows as volumes; a file is one task's work either way."""

from __future__ import annotations

import gzip
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# NIfTI-1 data type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(data x,y,z, 4x4 affine, spacing) of a NIfTI-1 file, compressed or not."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    steps = struct.unpack(order + "8f", data[76:108])
    offset = int(struct.unpack(order + "f", data[108:112])[0])
    affine = np.vstack([np.frombuffer(data[280:328], order + "f4").reshape(3, 4), [0, 0, 0, 1]]).astype(float)
    shape = [max(1, d) for d in dims[1:4]]
    values = np.frombuffer(data, order + KINDS[code], int(np.prod(shape)), offset).reshape(shape, order="F")
    return values, affine, list(steps[1:4])


def head(content: bytes) -> tuple[list[int], np.ndarray, list[float]]:
    """(size, 4x4 affine, spacing) from the first 352 bytes; the voxels are not unpacked."""
    data = zlib.decompressobj(31).decompress(content, 352) if content[:2] == b"\x1f\x8b" else content[:352]
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", data[40:56])
    steps = struct.unpack(order + "8f", data[76:108])
    affine = np.vstack([np.frombuffer(data[280:328], order + "f4").reshape(3, 4), [0, 0, 0, 1]]).astype(float)
    return [max(1, d) for d in dims[1:4]], affine, list(steps[1:4])


def header(shape: tuple[int, int, int], spacing: tuple[float, float, float], affine: np.ndarray, code: int = 2) -> bytes:
    """A NIfTI-1 header with its four bytes of padding."""
    out = bytearray(352)
    struct.pack_into("<i", out, 0, 348)
    struct.pack_into("<8h", out, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, code, 8 * np.dtype(KINDS[code]).itemsize)
    struct.pack_into("<8f", out, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<f", out, 108, 352)
    struct.pack_into("<h", out, 254, 1)
    out[280:328] = np.asarray(affine[:3], "<f4").tobytes()
    out[344:348] = b"n+1\0"
    return bytes(out)


def label_rows(files: DataFrame) -> DataFrame:
    """(path, label, x, y, z) of every labelled voxel of binaryFile rows (path, content); a file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                values = parse(content)[0]
                x, y, z = np.nonzero(values)
                yield pd.DataFrame({"path": path, "label": values[x, y, z].astype(np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32), "z": z.astype(np.int32)})

    return files.select("path", "content").mapInPandas(run, "path string, label int, x int, y int, z int")


def geometry(files: DataFrame) -> DataFrame:
    """(path, size, spacing, origin, affine) of binaryFile rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                size, affine, spacing = head(content)
                out.append((path, size, [float(s) for s in spacing], affine[:3, 3].tolist(), affine[:3].ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "size", "spacing", "origin", "affine"])

    return files.select("path", "content").mapInPandas(run, "path string, size array<int>, spacing array<double>, origin array<double>, affine array<double>")


def volumes(masks: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """(name, content): a compressed label volume of each row of masks (key, label, voxels: array of x, y, z).

    grids: (key, size, spacing, affine), one a case. The name is key/label.nii.gz, voxels hold 1; a mask without
    voxels gives an empty volume.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, label, voxels, size, spacing, affine in rows.itertuples(index=False):
                data = np.zeros(size, np.uint8, order="F")
                if len(voxels):
                    data[tuple(np.array([[v["x"], v["y"], v["z"]] for v in voxels]).T)] = 1
                content = header(tuple(size), tuple(spacing), np.asarray(affine, float).reshape(3, 4)) + data.tobytes(order="F")
                out.append((f"{k}/{label}.nii.gz", gzip.compress(content, 6, mtime=0)))
            yield pd.DataFrame(out, columns=["name", "content"])

    rows = masks.join(grids, key).select(key, "label", "voxels", "size", "spacing", "affine")
    return rows.mapInPandas(run, "name string, content binary")


@dataclass
class Written(WriterCommitMessage):
    """(path, its name until the job commits) of the files of a task."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Writes (name, content) rows below a folder under other names, which become their own when the whole job commits.

    Files of tasks that fail are removed with the job or stay under the other name, so nothing unfinished is ever seen.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = self._opened()
        done = []
        for row in rows:
            path = posixpath.normpath(posixpath.join(root, row["name"]))
            if not path.startswith(root.rstrip("/") + "/"):
                raise ValueError(f"{row['name']} leads out of the folder")
            store.create_dir(posixpath.dirname(path))
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part, compression=None) as f:
                f.write(row["content"])
            done.append((path, part))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = self._opened()
        for m in messages:
            for path, part in m.files if m else []:
                store.move(part, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = self._opened()
        for m in messages:
            for _, part in m.files if m else []:
                store.delete_file(part)


class Files(DataSource):
    """Format whole_files; option path: a folder that all executors share, as a path or a URI that pyarrow.fs opens."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
