"""Table functions: rows out of a row (voxels of a volume) or out of a batch of rows (problems of submissions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from voxloom.functions.policy import STRAY_VOXELS


@udtf(returnType="label int, x int, y int, z int")
class VolumeVoxels:
    """volume_voxels(content): labelled voxels of a NIfTI or NRRD file; none of a null."""

    def eval(self, content: bytes) -> Iterator[tuple[int, int, int, int]]:
        from voxloom.sources import nrrd, volumes

        if content is None:
            return
        values = (nrrd if content[:4] == b"NRRD" else volumes).parse(bytes(content))[0]
        for x, y, z in np.argwhere(values).tolist():
            yield int(values[x, y, z]), x, y, z


@arrow_udtf(returnType="key bigint, level string, code string, subject string")
class SubmissionProblems:
    """submission_problems(TABLE(rows), required, optional) over rows (key, segments, voxels, seconds), one a submission.

    Segments and their voxels are arrays of one length, seconds are null if unknown. Names are joined by commas. Of a
    submission errors come before warnings, each in the order of the rules; without problems it has one row of nulls.
    """

    def eval(self, rows: pa.RecordBatch, required: pa.Array, optional: pa.Array) -> Iterator[pa.Table]:
        if not len(rows):
            return
        must, may = ([n for n in names[0].as_py().split(",") if n] for names in (required, optional))
        n, lists = len(rows), rows.column("segments")
        names = pc.list_flatten(lists).dictionary_encode()
        there = pc.is_valid(names.indices).to_numpy(zero_copy_only=False)
        of = pc.list_parent_indices(lists).to_numpy()[there]
        voxels = pc.fill_null(pc.list_flatten(rows.column("voxels")), 0).to_numpy()[there]
        # segments by their place in the order of names
        ordered = sorted(names.dictionary.to_pylist())
        place = {name: i for i, name in enumerate(ordered)}
        segment = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.drop_null().to_numpy()]
        pairs, group = np.unique(of * len(ordered) + segment, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, group, voxels)
        row, segment = np.divmod(pairs, max(1, len(ordered)))

        found = {"error": [], "warning": []}
        for name in [*must, *may]:
            count = np.zeros(n, np.int64)
            known = segment == place.get(name, -1)
            count[row[known]] = sums[known]
            level, code = ("error", "empty_required_segment") if name in must else ("warning", "empty_optional_segment")
            for lev, c, at in ((level, code, count == 0), ("error", "stray_voxels", (count != 0) & (count <= STRAY_VOXELS))):
                at = np.flatnonzero(at)
                found[lev].append((at, c, pa.repeat(name, len(at))))
        other = (sums > 0) & ~np.isin(segment, [place[name] for name in (*must, *may) if name in place])
        found["error"].append((row[other], "unexpected_segment", pa.array(ordered, pa.string()).take(pa.array(segment[other]))))
        fast = np.flatnonzero(pc.fill_null(pc.less(rows.column("seconds"), 60), False).to_numpy(zero_copy_only=False))
        said = [f"{x:.0f}" for x in rows.column("seconds").take(pa.array(fast)).to_pylist()]
        found["warning"].append((fast, "implausibly_fast", pa.array(said, pa.string())))

        parts = [(at, level, code, subject) for level in found for at, code, subject in found[level]]
        none = np.ones(n, bool)
        none[np.concatenate([at for at, *_ in parts])] = False
        none = np.flatnonzero(none)
        parts.append((none, None, None, pa.nulls(len(none), pa.string())))
        for at, level, code, subject in parts:
            if len(at):
                key = rows.column("key").cast(pa.int64()).take(pa.array(at))
                level, code = (pa.repeat(pa.scalar(x, pa.string()), len(at)) for x in (level, code))
                yield pa.table([key, level, code, subject.cast(pa.string())], ["key", "level", "code", "subject"])


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    spark.udtf.register("volume_voxels", VolumeVoxels)
    spark.udtf.register("submission_problems", SubmissionProblems)
