"""Readers: one Python data source over any number of point files, split into record or byte ranges.

``read_clouds`` gives ``pid, file_ix, x, y, z`` and the numeric attributes that all files share;
``pid`` grows with the file's number and the row, and rows of a file are numbered from 0 without
gaps. Rows with a non-finite coordinate are dropped. Colours are scaled by the largest value of
their file to ``rgb`` in 0 to 1.

Files are listed by Hadoop's file system and their headers read in tasks. Binary files are cut
into ranges of records. Text is cut into ranges of bytes; a range has the lines that begin in it, and a
first pass counts the lines of each, so that a second one knows their numbers. Small files
share a task. Comparisons of x, y or z with numbers are pushed into the source: coordinates are
decoded first and the other columns of the rows left alone; ranges that a table of zones
(:func:`write_zones`) shows to lie outside are not planned at all. ``columns`` are the only ones decoded.
"""

from __future__ import annotations

import base64
import contextlib
import math
import operator
import os
import pickle
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from standscan.operators.points import crop, finite, union_common
from standscan.sources.layouts import LAYOUTS, TEXT, Layout, clean_name, columns, is_number

FILE_STEP = 1 << 44
NPZ_ROWS = 1 << 20  # rows of an archive that one task reads
TASK_ROWS = 1 << 21  # rows of files that one task reads
TEXT_BYTES = 32 << 20  # bytes of text that one task reads
BATCH_ROWS = 100_000
READ = 4 << 20
COMPARED = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


# ---------------------------------------------------------------- files


def _open(path: str):
    """A file by address or local name; names may hold characters that addresses may not."""
    if path.startswith("file://") or "://" not in path:
        return pafs.LocalFileSystem().open_input_file(os.path.abspath(path.removeprefix("file://")))
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def list_files(spark: SparkSession, patterns: str | Sequence[str]) -> list[tuple[str, int]]:
    """``(address, bytes)`` of the files that the patterns match in any file system of Hadoop's, by pattern and name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        where = pattern if "://" in pattern else "file://" + os.path.abspath(os.path.expanduser(pattern))
        glob = jvm.org.apache.hadoop.fs.Path(where)
        fs = glob.getFileSystem(conf)
        listed = [fs.getFileStatus(glob)] if fs.exists(glob) else fs.globStatus(glob) or []  # a name may hold a glob's marks itself
        found = [(re.sub("^file:/+", "file:///", s.getPath().toString()), s.getLen()) for s in listed if s.isFile()]
        if not found:
            raise FileNotFoundError(f"{pattern}: no such file")
        out += sorted(found)
    return out


def expand_paths(spark: SparkSession, patterns: str | Sequence[str]) -> list[str]:
    return [path for path, _ in list_files(spark, patterns)]


class _Head:
    """Line reads over an Arrow file, which has none of its own."""

    def __init__(self, handle) -> None:
        self.handle = handle

    def readline(self) -> bytes:
        start, out = self.handle.tell(), b""
        while b"\n" not in out:
            piece = self.handle.read(4096)
            if not piece:
                return out
            out += piece
        line = out[: out.index(b"\n") + 1]
        self.handle.seek(start + len(line))
        return line

    def read(self, n: int = -1) -> bytes:
        return self.handle.read(n)

    def tell(self) -> int:
        return self.handle.tell()


def kind_of(path: str) -> str:
    return os.path.splitext(path)[1].lower().lstrip(".")


def read_layout(path: str, kind: str) -> Layout:
    with _open(path) as handle:
        return LAYOUTS[kind](_Head(handle))


def _layouts(spark: SparkSession, paths: Sequence[str]) -> list[Layout]:
    """The headers of all files, read in tasks if there are several."""

    def told(path: str) -> bytes:
        try:
            return pickle.dumps(read_layout(path, kind_of(path)))
        except Exception as error:  # raised again by the driver
            return pickle.dumps(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("ix"), pa.array([told(p) for p in batch.column("path").to_pylist()], pa.binary())], names=["ix", "layout"])

    if len(paths) > 1:
        named = spark.createDataFrame(list(enumerate(paths)), "ix int, path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
        raw = [bytes(r["layout"]) for r in sorted(named.mapInArrow(run, "ix int, layout binary").collect(), key=lambda r: r["ix"])]
    else:
        raw = [told(p) for p in paths]
    out = [pickle.loads(r) for r in raw]
    for layout in out:
        if isinstance(layout, Exception):
            raise layout
    return out


# ---------------------------------------------------------------- ranges


@dataclass(frozen=True)
class Piece:
    """``rows`` rows of a file from number ``first`` on; of a text, those of the lines that begin in ``begin`` to ``end``."""

    ix: int
    path: str
    layout: Layout
    first: int
    rows: int
    begin: int = 0
    end: int = 0


def text_lines(handle, head: int, begin: int, end: int) -> Iterator[list[bytes]]:
    """The lines, blank ones left out, that begin in a range of bytes; ``head`` is where the first line begins."""
    at = begin - 1 if begin > head else begin  # a line begins where one ends just before
    cut_first, rest = begin > head, b""
    handle.seek(at)
    while True:
        piece = handle.read(READ)
        rest += piece
        whole = rest[: rest.rfind(b"\n") + 1] if piece else rest
        if whole:
            rest, lines, kept = rest[len(whole) :], whole.split(b"\n"), []
            if whole.endswith(b"\n"):
                lines.pop()
            for line in lines:
                start, at = at, at + len(line) + 1
                if cut_first:
                    cut_first = False
                elif start >= end:
                    yield kept
                    return
                elif line.strip():
                    kept.append(line)
            yield kept
        if not piece:
            return


def _values(lines: list[bytes], layout: Layout) -> list[list[float | None]]:
    """The numbers of each column; null for a field that is missing or no number."""
    width, out = len(layout.dtype), []
    for line in lines:
        fields = line.decode("utf-8", "replace").split(layout.mark)[:width]
        out.append([float(f) if is_number(f) else None for f in fields] + [None] * (width - len(fields)))
    return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(width)]


def _text_pieces(spark: SparkSession, files: list[tuple[int, str, Layout, int]]) -> tuple[dict[int, list[Piece]], dict[int, np.ndarray]]:
    """The byte ranges of texts with the numbers of their rows, and how many numbers each column has."""
    ranges = [(ix, n, path, a, min(a + TEXT_BYTES, size)) for n, (ix, path, layout, size) in enumerate(files) for a in range(layout.offset, max(size, layout.offset + 1), TEXT_BYTES)]
    layouts = [f[2] for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                layout, rows, numbers = layouts[r["n"]], 0, np.zeros(len(layouts[r["n"]].dtype), "i8")
                with _open(r["path"]) as handle:
                    for lines in text_lines(handle, layout.offset, r["a"], r["b"]):
                        rows += len(lines)
                        if layout.count < 0:
                            numbers += [len(c) - c.count(None) for c in _values(lines, layout)]
                out.append({"n": r["n"], "a": r["a"], "b": r["b"], "rows": rows, "numbers": numbers.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("rows", pa.int64()), ("numbers", pa.list_(pa.int64()))]))

    table = spark.createDataFrame(ranges, "ix int, n int, path string, a bigint, b bigint").repartition(max(1, min(len(ranges), 64 * spark.sparkContext.defaultParallelism)))
    counted = sorted(table.mapInArrow(run, "n int, a bigint, b bigint, rows bigint, numbers array<bigint>").collect(), key=lambda r: (r["n"], r["a"]))
    pieces, seen, by_file = {}, {}, defaultdict(list)
    for r in counted:
        by_file[r["n"]].append(r)
    for n, (ix, path, layout, _) in enumerate(files):
        own = by_file[n]
        firsts = accumulate((r["rows"] for r in own), initial=0)
        limit = math.inf if layout.count < 0 else layout.count
        made = [Piece(ix, path, layout, a, int(min(r["rows"], limit - a)), r["a"], r["b"]) for a, r in zip(firsts, own, strict=False) if a < limit]
        pieces[ix] = [p for p in made if p.rows]
        seen[ix] = np.sum([r["numbers"] for r in own], axis=0)
    return pieces, seen


def _record_pieces(ix: int, path: str, layout: Layout) -> list[Piece]:
    return [Piece(ix, path, layout, a, min(TASK_ROWS, layout.count - a)) for a in range(0, layout.count, TASK_ROWS)]


# ---------------------------------------------------------------- the data source


def _spark_type(dtype: np.dtype) -> T.DataType:
    kind, size = dtype.kind, dtype.itemsize
    if kind == "f":
        return T.FloatType() if size <= 4 else T.DoubleType()
    width = size * (2 if kind == "u" else 1)
    return T.ByteType() if width == 1 else T.ShortType() if width == 2 else T.IntegerType() if width == 4 else T.LongType()


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smaller type that holds the values of both, as far as a double does."""
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if a in order and b in order:
        return max(a, b, key=order.index)
    return a if a == b else T.DoubleType()


def layout_columns(layout: Layout) -> dict[str, T.DataType]:
    sample = columns(layout, np.zeros(0, layout.dtype))
    found = {clean_name(k): T.DoubleType() if clean_name(k) in ("x", "y", "z") else _spark_type(v.dtype) for k, v in sample.items()}
    if not all(c in found for c in "xyz"):
        raise ValueError(f"a cloud needs columns x, y and z; this one has {', '.join(sorted(found))}")
    return found


class Group(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces


class PointReader(DataSourceReader):
    def __init__(self, schema: T.StructType, pieces: list[Piece], zones: str | None) -> None:
        self.schema, self.pieces, self.zones = schema, pieces, zones
        self.names = schema.names[2:]
        self.arrow = to_arrow_schema(schema)
        self.tests: list[tuple[str, type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            compared = type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in ("x", "y", "z")
            if compared and isinstance(f.value, (int, float)) and math.isfinite(f.value):
                self.tests.append((f.attribute[0], type(f), float(f.value)))
            else:
                yield f

    def _outside(self, low: dict[str, float], high: dict[str, float]) -> bool:
        """Whether a test excludes all rows between these bounds; none does so if a bound is NaN."""
        below = {LessThan: operator.ge, LessThanOrEqual: operator.gt}
        above = {GreaterThan: operator.le, GreaterThanOrEqual: operator.lt}
        return any(below[t](low[c], v) if t in below else above[t](high[c], v) for c, t, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        left = self.pieces
        if self.zones and self.tests:
            fs, inner = pafs.FileSystem.from_uri(self.zones)
            known = {(z["path"], z["zone"]): z for z in ds.dataset(inner, format="parquet", filesystem=fs).to_table().to_pylist()}
            zone = lambda p: None if p.layout.text else known.get((p.path, p.first // TASK_ROWS))
            left = [p for p in left if (z := zone(p)) is None or z["rows"] != p.rows or not self._outside({c: z[f"low_{c}"] for c in "xyz"}, {c: z[f"high_{c}"] for c in "xyz"})]
        groups, held = [[]], 0
        for piece in left:
            if groups[-1] and held + piece.rows > TASK_ROWS:
                groups.append([])
                held = 0
            groups[-1].append(piece)
            held += piece.rows
        self.pieces = []
        return [Group(g) for g in groups]

    def _hits(self, xyz: dict[str, np.ndarray]) -> np.ndarray:
        """The rows that pass the tests. As in Spark, NaN is larger than all numbers; a masked value is null and fails."""
        keep = np.ones(len(xyz["x"]), bool)
        for c, t, v in self.tests:
            passed = COMPARED[t](xyz[c], v)
            if t in (GreaterThan, GreaterThanOrEqual):
                passed |= np.isnan(xyz[c])
            keep &= np.ma.filled(passed, False)
        return np.flatnonzero(keep)

    def _batch(self, piece: Piece, first: int, values: dict[str, np.ndarray], hits: np.ndarray) -> pa.RecordBatch:
        made = [pa.array(np.full(len(hits), piece.ix, "i4")), pa.array(first + hits)]
        for name, field in zip(self.names, list(self.arrow)[2:], strict=True):
            v = values[name]
            if isinstance(v, np.ma.MaskedArray):
                whole = pa.types.is_integer(field.type)
                absent = np.ma.getmaskarray(v) | (~np.isfinite(v.data) if whole else False)
                made.append(pa.array(np.where(absent, 0, v.data).astype(field.type.to_pandas_dtype()), mask=np.asarray(absent)))
            else:
                made.append(pa.array(np.ascontiguousarray(v.astype(field.type.to_pandas_dtype()))))
        return pa.RecordBatch.from_arrays(made, schema=self.arrow)

    def _records(self, piece: Piece, handle) -> Iterator[pa.RecordBatch]:
        layout = piece.layout
        for first in range(piece.first, piece.first + piece.rows, BATCH_ROWS):
            n = min(BATCH_ROWS, piece.first + piece.rows - first)
            handle.seek(layout.offset + first * layout.dtype.itemsize)
            records = np.frombuffer(handle.read(n * layout.dtype.itemsize), layout.dtype)
            hits = np.arange(n)
            if self.tests:
                hits = self._hits({k: np.asarray(v, "f8") for k, v in columns(layout, records, ("x", "y", "z")).items()})
                if not len(hits):
                    continue
                if len(hits) < n:
                    records = records[hits]
            values = {clean_name(k): v for k, v in columns(layout, records, self.names).items()}
            yield self._batch(piece, first, values, hits)

    def _text(self, piece: Piece, handle) -> Iterator[pa.RecordBatch]:
        first, names = piece.first, [clean_name(n) for n in piece.layout.dtype.names]
        for lines in text_lines(handle, piece.layout.offset, piece.begin, piece.end):
            for at in range(0, len(lines), BATCH_ROWS):
                part = lines[at : at + BATCH_ROWS][: max(0, piece.first + piece.rows - first)]
                if not part:
                    continue
                values = {}
                for name, column in zip(names, _values(part, piece.layout), strict=True):
                    absent = np.array([v is None for v in column])
                    values[name] = np.ma.MaskedArray(np.array([0.0 if v is None else v for v in column]), absent)
                hits = self._hits(values)
                if len(hits):
                    yield self._batch(piece, first, {k: v[hits] for k, v in values.items()}, hits)
                first += len(part)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            with _open(piece.path) as handle:
                yield from (self._text if piece.layout.text else self._records)(piece, handle)


class PointSource(DataSource):
    """The files described in the option ``pieces``, with the given schema; see :func:`scan`."""

    @classmethod
    def name(cls) -> str:
        return "pointfiles"

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(schema, pickle.loads(base64.b64decode(self.options["pieces"])), self.options.get("zones"))


def scan(spark: SparkSession, files: Sequence[tuple[int, str, int]], wanted: Sequence[str] | None = None, zones: str | None = None) -> DataFrame:
    """``(file_ix, row, x, y, z, ...)`` of numbered files ``(number, address, bytes)``, in one scan."""
    layouts = _layouts(spark, [f[1] for f in files])
    texts = [(ix, path, layout, size) for (ix, path, size), layout in zip(files, layouts, strict=True) if layout.text]
    pieces, seen = _text_pieces(spark, texts) if texts else ({}, {})
    shared: dict[str, T.DataType] | None = None
    for (ix, path, _), layout in zip(files, layouts, strict=True):
        pieces.setdefault(ix, []) if layout.text else pieces.update({ix: _record_pieces(ix, path, layout)})
        own = layout_columns(layout)
        if layout.text and layout.count < 0:
            own = {k: t for (k, t), n in zip(own.items(), seen[ix], strict=True) if n or k in ("x", "y", "z")}
        shared = own if shared is None else {k: _wider(t, own[k]) for k, t in shared.items() if k in own}
    kept = {k: t for k, t in shared.items() if k in ("x", "y", "z") or wanted is None or k in wanted}
    schema = T.StructType([T.StructField("file_ix", T.IntegerType()), T.StructField("row", T.LongType()), *[T.StructField(k, t) for k, t in kept.items()]])
    spark.dataSource.register(PointSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    packed = base64.b64encode(pickle.dumps([p for ix, _, _ in files for p in pieces[ix]])).decode()
    reader = spark.read.format("pointfiles").schema(schema).option("pieces", packed)
    return (reader.option("zones", zones) if zones else reader).load()


def write_zones(spark: SparkSession, patterns: str | Sequence[str], path: str) -> str:
    """Write the bounds of each range of ``TASK_ROWS`` records of the binary files as a table, for later crops; returns its address."""
    files = [(ix, p, size) for ix, (p, size) in enumerate(list_files(spark, patterns)) if kind_of(p) in LAYOUTS and kind_of(p) not in TEXT]
    names = spark.createDataFrame([(ix, p) for ix, p, _ in files], "file_ix int, path string")
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    zones = scan(spark, files, ()).groupBy("file_ix", F.floor(F.col("row") / TASK_ROWS).alias("zone")).agg(F.count("*").alias("rows"), *bounds)
    where = path if "://" in path else "file://" + os.path.abspath(path)
    zones.join(names, "file_ix").drop("file_ix").write.mode("overwrite").parquet(where)
    return where


# ---------------------------------------------------------------- archives


@dataclass(frozen=True)
class _Array:
    """Where a column lies in a member of an archive: its first value, and the values from row to row."""

    member: str
    start: int
    first: int
    step: int
    dtype: np.dtype


def _npz_members(path: str) -> dict[str, tuple[int, tuple, bool, np.dtype]]:
    """``(start of the data, shape, column-major, type)`` of every array, from the headers alone."""
    found = {}
    with _open(path) as handle, zipfile.ZipFile(handle) as packed:
        for member in packed.namelist():
            with packed.open(member) as body:
                version = np.lib.format.read_magic(body)
                head = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, column_major, dtype = head(body)
                found[member] = (body.tell(), shape, column_major, dtype)
    return found


def _npz_columns(path: str) -> tuple[dict[str, _Array], int]:
    """The columns of the file and its number of points."""
    found, made = _npz_members(path), {}
    named = {m.removesuffix(".npy"): m for m in found}
    if "xyz" in named:
        start, shape, column_major, dtype = found[named.pop("xyz")]
        n = shape[0]
        made = {c: _Array("xyz.npy", start, k * n if column_major else k, 1 if column_major else shape[1], dtype) for k, c in enumerate("xyz")}
    else:
        named = {clean_name(k): m for k, m in named.items()}
        n = found[named["x"]][1][0]
    for name, member in named.items():
        start, shape, _, dtype = found[member]
        if shape == (n,) and dtype.kind in "iuf" and name not in made:
            made[name] = _Array(member, start, 0, 1, dtype)
    return made, n


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of one file; an ``xyz`` array passes through with the columns as long as it.

    The driver reads the arrays' headers; tasks read ranges of rows. In a compressed file a
    task inflates, piece by piece, what lies before its range.
    """
    held, n = _npz_columns(path)
    kinds = {name: T.DoubleType() if name in tuple("xyz") else _spark_type(at.dtype) for name, at in held.items()}
    schema = T.StructType([T.StructField("row", T.LongType()), *[T.StructField(k, t) for k, t in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        with contextlib.ExitStack() as stack:
            # A file of its own for each column: members of one open archive disturb each other's relative seeks.
            packed = {name: stack.enter_context(zipfile.ZipFile(stack.enter_context(_open(path)))) for name in held}
            bodies = {name: stack.enter_context(packed[name].open(at.member)) for name, at in held.items()}
            for batch in batches:
                rows = batch.column("id")
                if not len(rows):
                    continue
                columns = [rows]
                for (name, at), field in zip(held.items(), list(arrow)[1:], strict=True):
                    bodies[name].seek(at.start + (at.first + rows[0].as_py() * at.step) * at.dtype.itemsize)
                    raw = bodies[name].read(((len(rows) - 1) * at.step + 1) * at.dtype.itemsize)
                    columns.append(pa.array(np.frombuffer(raw, at.dtype)[:: at.step].astype(field.type.to_pandas_dtype())))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spark.range(0, n, 1, max(1, -(-n // NPZ_ROWS))).mapInArrow(run, schema)


# ---------------------------------------------------------------- clouds


def _scaled_colours(df: DataFrame) -> DataFrame:
    """``rgb`` in 0 to 1: values are bytes if their file's largest is beyond 1, 16-bit numbers if beyond 255."""
    if not all(c in df.columns for c in "rgb"):
        return df
    tops = df.groupBy("file_ix").agg(F.max(F.greatest("r", "g", "b")).alias("ss_top"))
    whole = F.when(F.col("ss_top") > 255, 65535.0).when(F.col("ss_top") > 1, 255.0).otherwise(1.0)
    scaled = df.join(tops, "file_ix").withColumn("rgb", F.struct(*[(F.col(c) / whole).cast("float").alias(c) for c in "rgb"]))
    return scaled.drop("r", "g", "b", "ss_top")


def _cloud(df: DataFrame, bounds: Sequence[float] | None) -> DataFrame:
    df = _scaled_colours(crop(finite(df), bounds))
    rest = [c for c in df.columns if c not in ("row", "file_ix", "x", "y", "z")]
    return df.select((F.col("file_ix").cast("bigint") * FILE_STEP + F.col("row")).alias("pid"), "file_ix", *[F.col(c).cast("double").alias(c) for c in "xyz"], *rest)


def _read(spark: SparkSession, files: Sequence[tuple[int, str, int]], bounds: Sequence[float] | None, wanted: Sequence[str] | None, zones: str | None) -> DataFrame:
    for _, path, _ in files:
        if kind_of(path) not in LAYOUTS and kind_of(path) != "npz":
            raise ValueError(f"no reader for files of kind .{kind_of(path)}")
    plain = [f for f in files if kind_of(f[1]) != "npz"]
    found = [(plain[0][0], _cloud(scan(spark, plain, wanted, zones), bounds))] if plain else []
    for ix, path, _ in files:
        if kind_of(path) == "npz":
            packed = read_npz(spark, path)
            kept = [c for c in packed.columns if wanted is None or c in ("row", "x", "y", "z", *wanted)]
            found.append((ix, _cloud(packed.select(*kept).withColumn("file_ix", F.lit(ix)), bounds)))
    return union_common([df for _, df in sorted(found, key=lambda f: f[0])])


def read_cloud(spark: SparkSession, path: str, bounds: Sequence[float] | None = None, file_ix: int = 0, columns: Sequence[str] | None = None, zones: str | None = None) -> DataFrame:
    """One file by its extension; of its attributes only ``columns``, if given."""
    if kind_of(path) not in LAYOUTS and kind_of(path) != "npz":
        raise ValueError(f"no reader for files of kind .{kind_of(path)}")
    return _read(spark, [(file_ix, *list_files(spark, path)[0])], bounds, columns, zones)


def read_clouds(spark: SparkSession, patterns: str | Sequence[str], bounds: Sequence[float] | None = None, columns: Sequence[str] | None = None, zones: str | None = None) -> DataFrame:
    """All files on their common columns, numbered in the order of the patterns and of their names.

    All but the NPZ archives are one scan, however many they are.
    """
    return _read(spark, [(ix, *f) for ix, f in enumerate(list_files(spark, patterns))], bounds, columns, zones)
