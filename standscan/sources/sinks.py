"""Writers. Tasks write the records of a file, each at its own place; the driver writes the header.

Rows are numbered in pid order over range partitions, so every record's place in the file is
known. In a folder that driver and executors share, tasks write into one hidden file, which
takes its name once all rows are in it; a task that is run again writes the same bytes to the same
places, and a failure leaves no file. Stores without writes at a place take bodies as objects of
their own, which one task joins, a few megabytes at a time.
"""

from __future__ import annotations

import contextlib
import csv
import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.operators.order import running_total
from standscan.session import discard, materialise
from standscan.sources.layouts import LAS_BASE, LAS_EXTRA, clean_name

COPY = 8 << 20


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def _records(batch: pa.RecordBatch, dtype: np.dtype, pack: Callable) -> np.ndarray:
    cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "ss_at"}
    records = np.zeros(batch.num_rows, dtype)
    pack(records, cols)
    return records


def _into_file(numbered: DataFrame, dtype: np.dtype, pack: Callable, path: str, header: bytes, count: int) -> None:
    hidden = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(hidden, "r+b") as out:
            for batch in batches:
                at = batch.column("ss_at").to_numpy()
                order = np.argsort(at)
                at, records = at[order], _records(batch, dtype, pack)[order]
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        out.seek(len(header) + (int(at[run[0]]) - 1) * dtype.itemsize)
                        out.write(records[run].tobytes())
                written += len(at)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([written], pa.int64())})

    try:
        with open(hidden, "wb") as out:
            out.write(header)
            out.truncate(len(header) + count * dtype.itemsize)
        rows = numbered.mapInArrow(run, "rows bigint").agg(F.sum("rows")).first()[0] or 0
        if rows != count:
            raise OSError(f"{rows} of {count} records were written to {path}")
        os.replace(hidden, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(hidden)


def _into_store(numbered: DataFrame, dtype: np.dtype, pack: Callable, path: str, header: bytes) -> None:
    folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            order = np.argsort(batch.column("ss_at").to_numpy())
            name = f"{base}/{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(_records(batch, dtype, pack)[order].tobytes())
            yield pa.RecordBatch.from_pydict({"first": pa.array([int(batch.column("ss_at").to_numpy().min())], pa.int64()), "name": [name]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path)
        hidden = f"{inner}.{uuid.uuid4().hex}"
        with fs.open_output_stream(hidden, compression=None) as out:
            out.write(header)
            for batch in batches:
                for name in batch.column("name").to_pylist():
                    with fs.open_input_stream(name) as part:
                        while piece := part.read(COPY):
                            out.write(piece)
        fs.move(hidden, inner)
        yield pa.RecordBatch.from_pydict({"done": [True]})

    parts = materialise(numbered.repartitionByRange("ss_at").sortWithinPartitions("ss_at").mapInArrow(write, "first bigint, name string"), "sink-parts")
    parts.orderBy("first").coalesce(1).mapInArrow(join, "done boolean").collect()
    fs, base = pafs.FileSystem.from_uri(folder)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(base)
    discard(parts)


def _write_records(df: DataFrame, dtype: np.dtype, pack: Callable, path: str, header: Callable[[int], bytes]) -> int:
    """Write all rows of ``df`` in pid order behind the header of their number, which is returned."""
    numbered = materialise(running_total(df, ["pid"], F.lit(1).cast("bigint"), "ss_at").drop("pid"), "sink-rows")
    count = numbered.count()
    where = _uri(path)
    if where.startswith("file://"):
        _into_file(numbered, dtype, pack, where.removeprefix("file://"), header(count), count)
    else:
        _into_store(numbered, dtype, pack, where, header(count))
    discard(numbered)
    return count


def _flat_colours(df: DataFrame) -> tuple[DataFrame, list[str]]:
    if "rgb" not in df.columns:
        return df, []
    top = df.agg(F.max(F.greatest("rgb.r", "rgb.g", "rgb.b")).alias("t")).first()["t"] or 0
    by = 255.0 if top <= 1 else 1.0
    full = {"r": "red", "g": "green", "b": "blue"}
    return df.withColumns({full[c]: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.col(f"rgb.{c}") * by))).cast("int") for c in "rgb"}).drop("rgb"), list(full.values())


def write_ply(df: DataFrame, path: str) -> int:
    """Binary little-endian PLY: doubles for xyz, bytes for colours, 32-bit integers and floats. Returns the points."""
    df, colours = _flat_colours(df)
    kinds = {n: t for n, t in df.dtypes if n not in ("pid", "file_ix", "x", "y", "z")}
    fields = [n for n, t in kinds.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
    scalar = {n: "u1" if n in colours else "<f4" if kinds[n] in ("float", "double") else "<i4" for n in fields}
    dtype = np.dtype([(c, "<f8") for c in "xyz"] + [(n, scalar[n]) for n in fields])
    names = {"u1": "uchar", "<f4": "float", "<i4": "int"}

    def pack(records: np.ndarray, cols: dict) -> None:
        for n in records.dtype.names:
            records[n] = cols[n]

    def header(count: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property double {c}" for c in "xyz"]]
        lines += [f"property {names[scalar[n]]} {n if n in colours else clean_name(n)}" for n in fields]
        return ("\n".join([*lines, "end_header"]) + "\n").encode()

    whole = df.select("pid", "x", "y", "z", *[F.coalesce(n, F.lit(-1).cast(kinds[n])).alias(n) if scalar[n] == "<i4" else n for n in fields])
    return _write_records(whole, dtype, pack, path, header)


def write_las(df: DataFrame, path: str, classification: str | None = None, scale: float = 0.001) -> int:
    """LAS 1.2, point format 3, coordinates in steps of ``scale`` from their minima. Returns the points.

    The other numeric columns are written as extra bytes, 32-bit floats under their names.
    """
    df, colours = _flat_colours(df)
    span = df.agg(*[f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [float(span[f"lo{c}"] or 0.0) for c in "xyz"]
    taken = {"pid", "file_ix", "x", "y", "z", classification, "intensity", *colours}
    extra = [n for n, t in df.dtypes if n not in taken and t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")]
    dtype = np.dtype(LAS_BASE + LAS_EXTRA[3] + [(f"extra {n}", "<f4") for n in extra])
    wanted = ["x", "y", "z"] + [c for c in (classification, "intensity") if c and c in df.columns] + colours + extra

    def pack(records: np.ndarray, cols: dict) -> None:
        for k, c in enumerate("xyz"):
            records[c.upper()] = np.round((cols[c] - low[k]) / scale)
        if classification:
            records["classification"] = cols[classification].astype("i8").astype("u1")
        if "intensity" in cols and classification != "intensity":
            records["intensity"] = np.clip(cols["intensity"], 0, 65535)
        for c in colours:
            records[c] = cols[c].astype("u2") * 257
        for n in extra:
            records[f"extra {n}"] = np.array([np.nan if v is None else v for v in cols[n]], "f4") if cols[n].dtype == object else cols[n]

    def header(count: int) -> bytes:
        head = bytearray(227)
        head[:4], head[24], head[25] = b"LASF", 1, 2
        named = b"".join(struct.pack("<2xBB32s156x", 9, 0, n.encode()[:32]) for n in extra)
        block = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(named), b"Extra bytes") + named if extra else b""
        struct.pack_into("<HIIBHI5I", head, 94, 227, 227 + len(block), 1 if extra else 0, 3, dtype.itemsize, count, count, 0, 0, 0, 0)
        bounds = [v for c in "xyz" for v in (float(span[f"hi{c}"] or 0.0), float(span[f"lo{c}"] or 0.0))]
        struct.pack_into("<12d", head, 131, scale, scale, scale, *low, *bounds)
        return bytes(head) + block

    return _write_records(df.select("pid", *dict.fromkeys(wanted)), dtype, pack, path, header)


def write_cloud(df: DataFrame, path: str, label_key: str | None = None) -> int:
    """LAS for ``.las``, with ``label_key`` as classification; PLY otherwise. ``.laz`` is refused."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".laz":
        raise ImportError("LAZ needs a compressor that is not installed; write .las")
    return write_las(df, path, label_key) if kind == ".las" else write_ply(df, path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table (one row per object) as one file with a header."""
    df.toPandas().to_csv(path, index=False)


def write_rows(rows: list[dict], path: str) -> None:
    """A few rows as one file with a header; the columns are all that occur, in the order met."""
    names = list(dict.fromkeys(c for row in rows for c in row))
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        out.writerows(rows)


def write_json(report: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=2)


def save_transform(matrix: np.ndarray, path: str, note: str = "4x4 transform") -> None:
    np.savetxt(path, matrix, fmt="%.10f", header=note)


def load_transform(path: str) -> np.ndarray:
    return np.loadtxt(path).reshape(4, 4)
