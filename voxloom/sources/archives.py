"""ZIP archives as a batch source: members in ranges, each range read by its own task with ranged reads.

The driver reads the archive's directory once and deals the members in order into ranges of about equal size; a task seeks to
each member of its range, so an archive of any size is read by many tasks and never copied. Names that lead out of
the folder they are unpacked to are refused.
"""

from __future__ import annotations

import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MEMBERS = "name string, size bigint, packed bigint, crc bigint, content binary"
#: Bytes of packed members that a task reads, about.
RANGE = 64 << 20
STORED, DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED


@dataclass
class Members(InputPartition):
    """(name, size, packed size, checksum, method, place of the local header) of members that lie one after another."""

    members: list[tuple[str, int, int, int, int, int]]


def safe(name: str) -> bool:
    """Whether a member stays below the folder it is unpacked to."""
    plain = name.replace("\\", "/")
    return not (plain.startswith("/") or plain[1:2] == ":" or ".." in posixpath.normpath(plain).split("/"))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, size: int):
        self.uri, self.fields, self.size = uri, schema, size

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.uri)
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            found = [(i.filename, i.file_size, i.compress_size, i.CRC, i.compress_type, i.header_offset) for i in z.infolist() if not i.is_dir()]
        for name, *_, method, _ in found:
            if not safe(name):
                raise ValueError(f"{name} leads out of the archive's folder")
            if method not in (STORED, DEFLATED):
                raise ValueError(f"{name} is packed by a method that is not known ({method})")
        out, room = [], 0
        for m in sorted(found, key=lambda m: m[5]):
            if not out or room + m[2] > self.size:
                out.append(Members([]))
                room = 0
            out[-1].members.append(m)
            room += m[2]
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.fields)
        with_content = "content" in schema.names
        store, path = opened(self.uri)
        with store.open_input_file(path) as f:
            for name, size, packed, crc, method, at in partition.members:
                row = {"name": name, "size": size, "packed": packed, "crc": crc}
                if with_content:
                    f.seek(at)
                    local = struct.unpack("<4s5H3I2H", f.read(30))
                    f.seek(at + 30 + local[9] + local[10])  # after its own name and extra field
                    raw = f.read(packed)
                    row["content"] = zlib.decompress(raw, -15) if method == DEFLATED else raw
                    if len(row["content"]) != size or zlib.crc32(row["content"]) != crc:
                        raise ValueError(f"{name} is damaged")
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], schema.field(c).type) for c in schema.names], schema=schema)


class Archive(DataSource):
    """Format zip_members; options path and rangeBytes. `.schema(...)` without content lists members without reading them."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema, int(self.options.get("rangebytes", RANGE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archive)


def archive_root(members: DataFrame) -> str:
    """The one folder that all members lie in, with its slash; empty if they lie in several or in none."""
    tops = members.select(F.when(F.instr("name", "/") > 0, F.substring_index("name", "/", 1)).alias("top")).distinct().limit(2).collect()
    return f"{tops[0]['top']}/" if len(tops) == 1 and tops[0]["top"] else ""


def missing(members: DataFrame, present: DataFrame) -> DataFrame:
    """Members (name, size) that do not lie there (present: name, size) with the same size yet."""
    return members.join(present.select("name", "size"), ["name", "size"], "left_anti")


def unpack(spark: SparkSession, archive: str, folder: str, present: DataFrame | None = None, range_bytes: int = RANGE) -> None:
    """Writes all members below a folder; with `present` (name, size), only those that it lacks, whose content alone is read."""
    from voxloom.sources import volumes

    register(spark)
    volumes.register(spark)
    reader = spark.read.format("zip_members").option("rangeBytes", range_bytes)
    rows = reader.schema("name string, size bigint, content binary").load(archive)
    if present is not None:
        rows = missing(rows, present)
    rows.select("name", "content").write.format("whole_files").mode("append").save(folder)
