"""NRRD label volumes: a text header, then voxels, raw or gzip, in the file or beside none."""

from __future__ import annotations

import gzip
import re

import numpy as np

# Names of voxel types, and which axes of a space point against right, anterior, superior.
TYPES = {
    "i1": ("signed char", "int8", "int8_t"), "u1": ("uchar", "unsigned char", "uint8", "uint8_t"), "i2": ("short", "short int", "signed short", "int16", "int16_t"),
    "u2": ("ushort", "unsigned short", "unsigned short int", "uint16", "uint16_t"), "i4": ("int", "signed int", "int32", "int32_t"), "u4": ("uint", "unsigned int", "uint32", "uint32_t"),
    "i8": ("longlong", "long long", "int64", "int64_t"), "u8": ("ulonglong", "unsigned long long", "uint64", "uint64_t"), "f4": ("float",), "f8": ("double",),
}
KINDS = {name: kind for kind, names in TYPES.items() for name in names}
SIGNS = {"left": -1, "right": 1, "posterior": -1, "anterior": 1, "inferior": -1, "superior": 1}
SHORT = {"L": "left", "R": "right", "P": "posterior", "A": "anterior", "I": "inferior", "S": "superior"}


def header(content: bytes) -> tuple[dict[str, str], int]:
    """(fields by lower-case name, where the voxels begin); ValueError if the blank line after the header is not there yet."""
    end = re.search(rb"\r?\n\r?\n", content)
    if not content.startswith(b"NRRD") or not end:
        raise ValueError("no NRRD header")
    fields = {}
    for line in content[: end.start()].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon and not line.startswith("#") and not value.startswith("="):
            fields[name.strip().lower()] = value.strip()
    return fields, end.end()


def vectors(text: str) -> list[list[float]]:
    return [[float(x) for x in v.split(",")] for v in re.findall(r"\(([^)]*)\)", text)]


def geometry(fields: dict[str, str]) -> tuple[list[int], np.ndarray, list[float]]:
    """(size, 4x4 affine to right, anterior, superior in mm, spacing), axes as they lie in the file, the fastest first."""
    size = [int(n) for n in fields["sizes"].split()]
    if len(size) != 3:
        raise ValueError(f"a volume of {len(size)} axes")
    affine = np.eye(4)
    if "space directions" in fields:
        affine[:3, :3] = np.array(vectors(fields["space directions"])).T
    elif "spacings" in fields:
        affine[:3, :3] = np.diag([float(x) for x in fields["spacings"].split()])
    if "space origin" in fields:
        affine[:3, 3] = vectors(fields["space origin"])[0]
    space = fields.get("space", "right-anterior-superior")
    names = [SHORT[c] for c in space] if space in ("LPS", "RAS", "LAS", "RPS") else space.lower().split("-")
    affine[:3] *= np.array([SIGNS.get(n, 1) for n in names[:3]], float)[:, None]
    return size, affine, np.linalg.norm(affine[:3, :3], axis=0).tolist()


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(data x,y,z, 4x4 affine, spacing) of an NRRD file with its voxels inside."""
    fields, start = header(content)
    if "data file" in fields or "datafile" in fields:
        raise ValueError("voxels are in another file")
    size, affine, spacing = geometry(fields)
    kind = ("<" if fields.get("endian", "little") == "little" else ">") + KINDS[fields["type"]]
    encoding, body = fields.get("encoding", "raw").lower(), content[start:]
    if encoding in ("gz", "gzip"):
        body = gzip.decompress(body)
    elif encoding != "raw":
        raise ValueError(f"unknown encoding {encoding}")
    return np.frombuffer(body, kind, int(np.prod(size))).reshape(size, order="F"), affine, spacing


def written(values: np.ndarray, affine: np.ndarray, packed: bool = True) -> bytes:
    """An NRRD file of a volume, in the space left-posterior-superior that medical tools write."""
    turned = np.array(affine, float)[:3] * np.array([-1, -1, 1])[:, None]
    vector = lambda v: "(" + ",".join(repr(float(x) + 0.0) for x in v) + ")"
    name = TYPES[values.dtype.str[1:]][-1]
    lines = [
        "NRRD0004", f"type: {name}", "dimension: 3", "space: left-posterior-superior", f"sizes: {' '.join(map(str, values.shape))}",
        f"space directions: {' '.join(vector(turned[:, k]) for k in range(3))}", "kinds: domain domain domain", "endian: little",
        f"encoding: {'gzip' if packed else 'raw'}", f"space origin: {vector(turned[:, 3])}",
    ]
    body = values.astype(values.dtype.newbyteorder("<")).tobytes(order="F")
    return "\n".join(lines).encode() + b"\n\n" + (gzip.compress(body, 6, mtime=0) if packed else body)


def head(content: bytes) -> tuple[list[int], np.ndarray, list[float]]:
    """(size, affine, spacing) from a file's beginning."""
    return geometry(header(content)[0])
