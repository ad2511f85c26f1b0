"""Ranges, pushed filters, zones, many files and parallel writes of point files."""

from __future__ import annotations

import io
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from standscan.sources import clouds, layouts, sinks


def ply(path, xyz, text=False, tail=""):
    lines = ["ply", f"format {'ascii' if text else 'binary_little_endian'} 1.0", f"element vertex {len(xyz)}", *[f"property double {c}" for c in "xyz"], "property int n", "element face 0", "end_header"]
    head = ("\n".join(lines) + "\n").encode()
    if text:
        path.write_bytes(head + "".join(f"{x} {y} {z} {i}\n" for i, (x, y, z) in enumerate(xyz)).encode() + tail.encode())
    else:
        records = np.zeros(len(xyz), [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("n", "<i4")])
        records["x"], records["y"], records["z"] = xyz.T
        records["n"] = np.arange(len(xyz))
        path.write_bytes(head + records.tobytes())


def plan(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_crop_is_pushed_into_the_scan(spark, tmp_path):
    xyz = np.random.default_rng(0).uniform(0, 100, (5000, 3))
    for text in (False, True):
        ply(tmp_path / "a.ply", xyz, text)
        df = clouds.read_cloud(spark, str(tmp_path / "a.ply"), bounds=(10, 20, 30, 25))
        told = plan(df)
        assert "BatchScan pointfiles" in told and "PushedFilters: [GreaterThanOrEqual(x,10" in told and "LessThanOrEqual(y,25" in told
        want = np.flatnonzero((xyz[:, 0] >= 10) & (xyz[:, 0] <= 30) & (xyz[:, 1] >= 20) & (xyz[:, 1] <= 25))
        got = df.orderBy("pid").collect()
        assert [r["pid"] for r in got] == want.tolist() == [r["n"] for r in got]
        whole = clouds.read_cloud(spark, str(tmp_path / "a.ply")).where("x between 10 and 30 and y between 20 and 25 and z is not null")
        assert whole.count() == len(want) and "PushedFilters: [GreaterThanOrEqual(x,10" in plan(whole)


def reader_of(spark, path, names=("n",), zones=None):
    listed = clouds.list_files(spark, str(path))
    layout = clouds.read_layout(listed[0][0], "ply")
    from pyspark.sql import types as T

    kinds = clouds.layout_columns(layout)
    schema = T.StructType([T.StructField("file_ix", T.IntegerType()), T.StructField("row", T.LongType()), *[T.StructField(k, kinds[k]) for k in ("x", "y", "z", *names)]])
    return clouds.PointReader(schema, clouds._record_pieces(0, listed[0][0], layout), zones)


def test_only_hits_are_decoded(spark, tmp_path, monkeypatch):
    xyz = np.column_stack([np.arange(400_000.0), np.zeros(400_000), np.ones(400_000)])
    ply(tmp_path / "a.ply", xyz)
    reader = reader_of(spark, tmp_path / "a.ply")
    left = list(reader.pushFilters([GreaterThanOrEqual(("x",), 350_000), LessThan(("x",), 350_010.0), EqualTo(("n",), 3)]))
    assert left == [EqualTo(("n",), 3)]
    decoded = []
    inner = layouts.columns
    monkeypatch.setattr(clouds, "columns", lambda layout, records, wanted=None: decoded.append((len(records), set(wanted))) or inner(layout, records, wanted))
    rows = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in rows) == 10 and rows[0].column("n").to_pylist() == list(range(350_000, 350_010))
    assert sum(n for n, wanted in decoded if "n" in wanted) == 10  # coordinates alone of all others
    assert [n for n, wanted in decoded if "n" not in wanted] == [100_000] * 4


def test_ranges_outside_the_zones_are_not_planned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clouds, "TASK_ROWS", 1000)
    xyz = np.column_stack([np.arange(10_000.0), np.zeros(10_000), np.ones(10_000)])
    xyz[7500, 0] = np.nan
    ply(tmp_path / "a.ply", xyz)
    zones = clouds.write_zones(spark, str(tmp_path / "a.ply"), str(tmp_path / "zones"))
    for tests, first in (([LessThanOrEqual(("x",), 1000)], [0, 1000]), ([GreaterThan(("x",), 8999)], [7000, 9000]), ([LessThan(("y",), 0.0)], []), ([], list(range(0, 10_000, 1000)))):
        reader = reader_of(spark, tmp_path / "a.ply", zones=zones)
        assert not list(reader.pushFilters(tests))
        assert [p.first for part in reader.partitions() for p in part.pieces] == first
    ply(tmp_path / "a.ply", xyz[:9500])  # a range that has changed since is read
    reader = reader_of(spark, tmp_path / "a.ply", zones=zones)
    list(reader.pushFilters([LessThan(("x",), 10)]))
    assert [p.first for part in reader.partitions() for p in part.pieces] == [0, 9000]
    monkeypatch.undo()
    whole = clouds.write_zones(spark, str(tmp_path / "a.ply"), str(tmp_path / "whole"))
    got = clouds.read_clouds(spark, str(tmp_path / "a.ply"), bounds=(5, -1, 6, 1), zones=whole)
    assert [r["n"] for r in got.orderBy("pid").collect()] == [5, 6]


def test_nan_and_null_compare_as_in_spark(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("nan 1 1\n2 bad 3\n4 5 6\n7 8\n")
    df = clouds.scan(spark, [(0, *clouds.list_files(spark, str(tmp_path / "a.xyz"))[0])])
    for test in ("x > 3", "x >= 4", "x < 3", "x <= 4", "y > 0", "z < 100", "x > -1 and y < 6"):
        plain = spark.createDataFrame([(0, float("nan"), 1.0, 1.0), (1, 2.0, None, 3.0), (2, 4.0, 5.0, 6.0), (3, 7.0, 8.0, None)], "row long, x double, y double, z double")
        assert sorted(r["row"] for r in df.where(test).collect()) == sorted(r["row"] for r in plain.where(test).collect()), test


@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.integers(0, 4), st.integers(1, 9), st.integers(1, 5), st.booleans())
@settings(max_examples=400, deadline=None)
def test_every_line_is_in_one_range(lines, head, step, read, ended):
    raw = b"#" * head + b"\n".join(lines) + (b"\n" if ended else b"")
    before, clouds.READ = clouds.READ, read
    try:
        got = [x for a in range(head, max(len(raw), head + 1), step) for part in clouds.text_lines(io.BytesIO(raw), head, a, min(a + step, len(raw))) for x in part]
    finally:
        clouds.READ = before
    assert got == [x for x in raw[head:].split(b"\n") if x.strip()]


def test_rows_of_texts_are_numbered_without_gaps(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-9, 9, (700, 3)).round(3)
    (tmp_path / "a.csv").write_text("X,Y,Z,Note\n" + "".join(f"{x},{y},{z},{'' if i % 2 else 'x'}\n" + "\n" * (i % 50 == 0) for i, (x, y, z) in enumerate(xyz)))
    ply(tmp_path / "b.ply", xyz, text=True, tail="3 0 1 2\n3 1 2 3\n")
    for size in (50, 777, 1 << 20):
        monkeypatch.setattr(clouds, "TEXT_BYTES", size)
        for name in ("a.csv", "b.ply"):
            got = clouds.read_cloud(spark, str(tmp_path / name)).orderBy("pid").toPandas()
            assert got["pid"].tolist() == list(range(700)) and np.array_equal(got[["x", "y", "z"]].to_numpy(), xyz)
            assert "note" not in got.columns


def test_a_repeated_header_line_is_a_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nx,y,z,w\n1,2,3,4\nx,y,z,w\n5,6,7,8\n")
    got = clouds.read_cloud(spark, str(tmp_path / "a.csv")).orderBy("pid").collect()
    assert [(r["pid"], r["w"]) for r in got] == [(0, 4.0), (2, 8.0)]


def test_many_small_files_are_one_scan(spark, tmp_path):
    for i in range(1200):
        np.save(tmp_path / f"t{i:04}.npy", np.full((2, 3 + i % 2), float(i)))
    (tmp_path / "more.xyz").write_text("1200 0 0 7\n")
    df = clouds.read_clouds(spark, [str(tmp_path / "t*.npy"), str(tmp_path / "more.xyz")])
    assert plan(df).count("BatchScan pointfiles (") == 1 and df.rdd.getNumPartitions() == 1 and df.columns == ["pid", "file_ix", "x", "y", "z"]
    got = df.groupBy("file_ix").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max(F.col("pid") - F.col("file_ix").cast("long") * clouds.FILE_STEP).alias("row")).orderBy("file_ix").collect()
    assert [tuple(r) for r in got] == [(i, 2, float(i), 1) for i in range(1200)] + [(1200, 1, 1200.0, 0)]


def test_columns_types_and_names_of_files(spark, tmp_path):
    (tmp_path / "a[1].xyz").write_text("x y z red green blue k\n0 0 0 255 0 0 1\n")
    (tmp_path / "b.xyz").write_text("x y z red green blue k\n0 0 0 65535 0 0 2\n")
    got = clouds.read_clouds(spark, [str(tmp_path / "a[1].xyz"), str(tmp_path / "b.xyz")]).orderBy("pid").collect()
    assert [(r["rgb"]["r"], r["k"]) for r in got] == [(1.0, 1.0), (1.0, 2.0)]
    only = clouds.read_clouds(spark, str(tmp_path / "*.xyz"), columns=["k"])
    assert only.columns == ["pid", "file_ix", "x", "y", "z", "k"]
    (tmp_path / "c.xyz").write_text("")
    for bad in ("c.xyz", "none.xyz", "a.unknown"):
        with pytest.raises((ValueError, FileNotFoundError)):
            clouds.read_cloud(spark, str(tmp_path / bad))


@pytest.mark.parametrize("kind", ["ply", "las"])
def test_parallel_writes_land_in_order(spark, tmp_path, kind, monkeypatch):
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("pid"), (F.col("id") * 0.5).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), (F.col("id") % 3).cast("int").alias("k")).repartition(7)
    path = str(tmp_path / f"a.{kind}")
    collected = []
    inner = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(inner(self)) or collected[-1])
    assert sinks.write_cloud(df, path, "k" if kind == "las" else None) == 5000
    assert sum(map(len, collected)) <= 4  # no record and no part passes through the driver
    monkeypatch.undo()
    got = clouds.read_cloud(spark, path).orderBy("pid").toPandas()
    assert np.allclose(got["x"], (4999 - np.arange(5000)) * 0.5) and os.listdir(tmp_path) == [f"a.{kind}"]
    none = df.limit(0)
    assert sinks.write_cloud(none, str(tmp_path / f"b.{kind}"), "k" if kind == "las" else None) == 0
    assert clouds.read_cloud(spark, str(tmp_path / f"b.{kind}")).count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("pid"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))

    def fail(records, cols):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        sinks._write_records(df, np.dtype([("x", "<f8")]), fail, str(tmp_path / "a.ply"), lambda n: b"head")
    assert os.listdir(tmp_path) == []


def test_stores_without_places_are_joined_by_a_task(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("x")).repartition(5)
    numbered = sinks.materialise(sinks.running_total(df, ["pid"], F.lit(1).cast("bigint"), "ss_at").drop("pid"), "test-sink")
    sinks._into_store(numbered, np.dtype([("x", "<f8")]), lambda r, c: r.__setitem__("x", c["x"]), "file://" + str(tmp_path / "a.bin"), b"12345678")
    assert np.array_equal(np.frombuffer((tmp_path / "a.bin").read_bytes()[8:], "<f8"), np.arange(3000.0)) and os.listdir(tmp_path) == ["a.bin"]
