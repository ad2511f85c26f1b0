"""Headers of point files: where fixed-width records start, how many there are, what they hold."""

from __future__ import annotations

import re
import struct
from collections.abc import Collection
from dataclasses import dataclass

import numpy as np

# Scalar type names of PLY headers.
PLY_SCALARS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
# Names that stand for others after cleaning.
ALIASES = {"red": "r", "green": "g", "blue": "b", "rf": "r", "gf": "g", "bf": "b", "scalar_intensity": "intensity"}
# The fields of LAS point formats 0 to 3 (public specification).
LAS_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
LAS_EXTRA = {0: [], 1: [("gps_time", "<f8")], 2: [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], 3: [("gps_time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]}
# The fields of LAS point formats 6 to 10 (public specification); wave packets are skipped.
LAS_BASE_6 = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
LAS_EXTRA_6 = {6: [], 7: LAS_EXTRA[2], 8: [*LAS_EXTRA[2], ("nir", "<u2")], 9: [], 10: [*LAS_EXTRA[2], ("nir", "<u2")]}
LAS_KEPT = ("intensity", "return_number", "number_of_returns", "classification", "red", "green", "blue")


def clean_name(raw: str) -> str:
    """Lower-case words joined by underscores, with the usual names of colours."""
    name = "_".join(re.findall(r"[0-9a-z]+", raw.lower()))
    return ALIASES.get(name, name)


@dataclass
class Layout:
    """Records of ``dtype`` from ``offset`` on, or lines of text from there; a negative count is unknown."""

    dtype: np.dtype
    count: int
    offset: int
    text: bool = False
    scale: tuple[float, float, float] | None = None
    shift: tuple[float, float, float] | None = None
    kept: tuple[str, ...] | None = None
    mark: str | None = None  # what parts the fields of a text, None for white space

    @property
    def names(self) -> list[str]:
        names = list(self.kept or self.dtype.names)
        return ["x", "y", "z", *names] if self.scale else names


def ply_layout(handle) -> Layout:
    lines = []
    if handle.readline().strip() != b"ply":
        raise ValueError("not a PLY file")
    while True:
        line = handle.readline()
        if not line:
            raise ValueError("the PLY header has no end")
        words = line.decode("latin-1").split()
        if words == ["end_header"]:
            break
        lines.append(words)
    kind = next((w[1] for w in lines if w[:1] == ["format"]), "")
    order = {"ascii": "<", "binary_little_endian": "<", "binary_big_endian": ">"}.get(kind)
    if order is None:
        raise ValueError(f"unknown PLY format {kind!r}")
    at = [i for i, w in enumerate(lines) if w[:1] == ["element"]]
    if not at or lines[at[0]][1] != "vertex":
        raise ValueError("points are read from files whose vertices come first")
    props = []
    for w in lines[at[0] + 1 : at[1] if len(at) > 1 else len(lines)]:
        if w[:1] == ["property"]:
            if w[1] == "list":
                raise ValueError(f"vertex property {w[-1]} has a varying length")
            props.append((w[2], order + PLY_SCALARS[w[1]]))
    return Layout(np.dtype(props), int(lines[at[0]][2]), handle.tell(), text=kind == "ascii")


def pcd_layout(handle) -> Layout:
    head: dict[str, list[str]] = {}
    while "DATA" not in head:
        line = handle.readline()
        if not line:
            raise ValueError("the PCD header has no DATA line")
        words = line.decode("latin-1").split()
        if words and not words[0].startswith("#"):
            head[words[0].upper()] = words[1:]
    kind = head["DATA"][0].lower()
    if kind not in ("ascii", "binary"):
        raise ValueError(f"PCD data of kind {kind} is not supported")
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    props = []
    for name, size, code, n in zip(head["FIELDS"], head["SIZE"], head["TYPE"], counts, strict=True):
        scalar = "<" + {"F": "f", "I": "i", "U": "u"}[code.upper()] + size
        props += [(f"{name}__{k}" if n > 1 else name, scalar) for k in range(n)]
    points = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    dtype = np.dtype(props)
    return Layout(dtype, points, handle.tell(), text=kind == "ascii", kept=tuple(n for n in dtype.names if "__" not in n))


def las_layout(handle) -> Layout:
    head = handle.read(375)
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, header_size = head[25], struct.unpack_from("<H", head, 94)[0]
    offset, _, kind, width, count = struct.unpack_from("<IIBHI", head, 96)
    if kind & 0x80:
        raise ImportError("LAZ needs a decompressor that is not installed; convert the file to LAS")
    if kind not in LAS_EXTRA and kind not in LAS_EXTRA_6:
        raise ValueError(f"LAS point format {kind} is not supported")
    if minor >= 4 and header_size >= 375 and count == 0:
        count = struct.unpack_from("<Q", head, 247)[0]
    fields = LAS_BASE + LAS_EXTRA[kind] if kind in LAS_EXTRA else LAS_BASE_6 + LAS_EXTRA_6[kind]
    spare = width - np.dtype(fields).itemsize
    dtype = np.dtype(fields + ([("spare", f"V{spare}")] if spare else []))
    kept = tuple(n for n in LAS_KEPT if n in dtype.names or n in ("return_number", "number_of_returns"))
    return Layout(dtype, count, offset, scale=struct.unpack_from("<3d", head, 131), shift=struct.unpack_from("<3d", head, 155), kept=kept)


def npy_layout(handle) -> Layout:
    version = np.lib.format.read_magic(handle)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(handle)
    if fortran or len(shape) != 2 or shape[1] < 3 or dtype.names:
        raise ValueError("an NPY cloud is a C-ordered matrix of at least three columns")
    names = ["x", "y", "z", *[f"f{i}" for i in range(3, shape[1])]]
    return Layout(np.dtype([(n, dtype) for n in names]), shape[0], handle.tell())


def is_number(field: str) -> bool:
    try:
        float(field)
    except ValueError:
        return False
    return "_" not in field


def text_layout(handle) -> Layout:
    """The first line that is not blank has the names if one of its fields is no number; the first mark found in it parts the fields."""
    line = ""
    while not line:
        at, raw = handle.tell(), handle.readline()
        if not raw:
            raise ValueError("the cloud has no line")
        line = raw.decode("utf-8", "replace").strip()
    mark = next((m for m in TEXT_MARKS if m in line), None)
    fields = [f.strip() for f in line.split(mark)]
    if all(is_number(f) for f in fields if f):
        names = [*"xyz", *[f"f{i}" for i in range(len(fields) - 3)]][: len(fields)]
    else:
        names, at = [clean_name(f) or f"f{i}" for i, f in enumerate(fields)], handle.tell()
    unique = [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]
    return Layout(np.dtype([(n, "f8") for n in unique]), -1, at, text=True, mark=mark)


# Marks between fields of a text, in the order in which they are looked for.
TEXT_MARKS = (";", ",")
TEXT = ("txt", "csv", "asc", "xyz", "pts")
LAYOUTS = dict.fromkeys(TEXT, text_layout) | {"ply": ply_layout, "pcd": pcd_layout, "las": las_layout, "laz": las_layout, "npy": npy_layout}


def columns(layout: Layout, records: np.ndarray, wanted: Collection[str] | None = None) -> dict[str, np.ndarray]:
    """Named columns of decoded records; only those whose clean names are ``wanted``, if given."""
    named = lambda n: wanted is None or clean_name(n) in wanted
    if not layout.scale:
        return {n: records[n] for n in layout.names if named(n)}
    out = {c: records[c.upper()] * layout.scale[k] + layout.shift[k] for k, c in enumerate("xyz") if named(c)}
    for n in filter(named, layout.kept):
        if n in ("return_number", "number_of_returns"):
            source, bits = (records["returns"], 4) if "returns" in records.dtype.names else (records["flags"], 3)
            out[n] = (source >> (bits if n == "number_of_returns" else 0)) & ((1 << bits) - 1)
        else:
            out[n] = records[n]
    return out
