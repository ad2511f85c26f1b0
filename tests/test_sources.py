from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.operators import render
from standscan.sources import clouds, sinks, synthetic
from standscan.streaming import counts


def test_ply_round_trip(spark, tmp_path):
    rows = [(i, 445600.123 + i, 5696580.5 - i, 472.25, i % 3 - 1, 0.5 * i) for i in range(1000)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, label int, hag float").repartition(3)
    assert sinks.write_ply(df, str(tmp_path / "a.ply")) == 1000
    got = clouds.read_cloud(spark, str(tmp_path / "a.ply")).orderBy("pid").toPandas()
    assert np.allclose(got["x"], [r[1] for r in rows]) and got["label"].tolist() == [r[4] for r in rows]


def test_las_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, 100.0 + i * 0.25, -5.5, 1.0 * i, 2) for i in range(50)], "pid long, x double, y double, z double, pred int")
    sinks.write_cloud(df, str(tmp_path / "a.las"), "pred")
    got = clouds.read_cloud(spark, str(tmp_path / "a.las"), bounds=(100, -10, 105, 10)).toPandas()
    assert len(got) == 21 and set(got["classification"]) == {2} and np.allclose(sorted(got["x"]), 100 + np.arange(21) * 0.25)
    with pytest.raises(ImportError):
        sinks.write_cloud(df, str(tmp_path / "a.laz"))


def test_las_of_newer_formats_and_extra_bytes(spark, tmp_path):
    import struct

    from standscan.sources.layouts import LAS_BASE_6, LAS_EXTRA_6

    dtype = np.dtype(LAS_BASE_6 + LAS_EXTRA_6[7])
    records = np.zeros(3, dtype)
    records["X"], records["returns"], records["classification"], records["red"] = [1, 2, 3], [0x21, 0x32, 0xF1], [2, 6, 200], [65535, 0, 0]
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HIIBHI", head, 94, 375, 375, 0, 7, dtype.itemsize, 0)
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10.0, 0.0, 0.0)
    struct.pack_into("<Q", head, 247, 3)
    (tmp_path / "new.las").write_bytes(bytes(head) + records.tobytes())
    got = clouds.read_cloud(spark, str(tmp_path / "new.las")).orderBy("x").collect()
    assert [(r["x"], r["return_number"], r["number_of_returns"], r["classification"]) for r in got] == [(10.5, 1, 2, 2), (11.0, 2, 3, 6), (11.5, 1, 15, 200)]
    df = spark.createDataFrame([(i, 1.0 * i, 0.0, 0.0, 1, 0.5 * i) for i in range(4)], "pid long, x double, y double, z double, pred int, hag float")
    sinks.write_cloud(df, str(tmp_path / "b.las"), "pred")
    raw = (tmp_path / "b.las").read_bytes()
    offset, blocks, width = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<I", raw, 100)[0], struct.unpack_from("<H", raw, 105)[0]
    assert blocks == 1 and b"LASF_Spec" in raw[:offset] and raw[227 + 54 + 4 : 227 + 54 + 7] == b"hag"
    assert [struct.unpack_from("<f", raw, offset + i * width + width - 4)[0] for i in range(4)] == [0.0, 0.5, 1.0, 1.5]
    assert clouds.read_cloud(spark, str(tmp_path / "b.las")).count() == 4


def test_text_pcd_npy(spark, tmp_path):
    (tmp_path / "a.txt").write_text("//X;Y;Z;R;G;B;Stump1\n1;2;3;255;0;0;7\n4;5;6;0;128;0;8\n")
    got = clouds.read_cloud(spark, str(tmp_path / "a.txt")).orderBy("pid").collect()
    assert [r["stump1"] for r in got] == [7.0, 8.0] and got[0]["rgb"]["r"] == 1.0
    (tmp_path / "b.xyz").write_text("1e5 2 3 9\n4 5 6 bad\n")
    got = clouds.read_cloud(spark, str(tmp_path / "b.xyz")).orderBy("pid").collect()
    assert got[0]["x"] == 1e5 and got[1]["f0"] is None
    (tmp_path / "c.pcd").write_text("FIELDS x y z i\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nPOINTS 2\nDATA ascii\n1 2 3 4\n5 6 nan 7\n")
    assert [r["i"] for r in clouds.read_cloud(spark, str(tmp_path / "c.pcd")).collect()] == [4]
    np.save(tmp_path / "d.npy", np.arange(12.0).reshape(3, 4))
    np.savez(tmp_path / "e.npz", xyz=np.arange(6.0).reshape(2, 3), hag=np.array([1.0, 2.0]))
    both = clouds.read_clouds(spark, [str(tmp_path / "d.npy"), str(tmp_path / "e.npz")])
    assert both.count() == 5 and "f3" not in both.columns
    assert clouds.read_cloud(spark, str(tmp_path / "e.npz")).agg(F.sum("hag")).first()[0] == 3.0
    with pytest.raises(FileNotFoundError):
        clouds.expand_paths(spark, str(tmp_path / "none*.ply"))
    with pytest.raises(ValueError):
        clouds.read_cloud(spark, "a.unknown")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_in_many_tasks(spark, tmp_path, monkeypatch, save):
    rng = np.random.default_rng(3)
    xyz, n = rng.normal(0, 9, (25_000, 3)), 25_000
    more = {"intensity": rng.integers(0, 60_000, n).astype("u2"), "hag": rng.normal(0, 1, n).astype(">f4"), "short": np.arange(3), "flat": np.ones((n, 2))}
    monkeypatch.setattr(clouds, "NPZ_ROWS", 7000)
    for name, arrays in (("c", {"xyz": xyz}), ("f", {"xyz": np.asfortranarray(xyz)}), ("s", {"X": xyz[:, 0], "Y": xyz[:, 1], "Z": xyz[:, 2]})):
        save(tmp_path / f"{name}.npz", **arrays, **more)
        df = clouds.read_npz(spark, str(tmp_path / f"{name}.npz"))
        assert df.rdd.getNumPartitions() == 4
        got = df.orderBy("row").toPandas()
        assert set(got.columns) == {"row", "x", "y", "z", "intensity", "hag"} and np.array_equal(got["row"], np.arange(n))
        assert np.array_equal(got[["x", "y", "z"]].to_numpy(), xyz)
        assert np.array_equal(got["intensity"], more["intensity"]) and np.array_equal(got["hag"], more["hag"].astype("f4"))
    save(tmp_path / "none.npz", xyz=np.empty((0, 3)))
    assert clouds.read_cloud(spark, str(tmp_path / "none.npz")).count() == 0


def test_forest_and_render(spark, tmp_path):
    df, centres = synthetic.make_forest(spark, 10, 3, 1, 1, 50)
    assert len(centres) == 3 and {r["label"] for r in df.select("label").distinct().collect()} == {0, 1, 2}
    assert df.count() == df.select("pid").distinct().count()
    stump = df.where("instance = 1").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max(F.hypot(F.col("x") - centres[1][0], F.col("y") - centres[1][1])).alias("r")).first()
    assert np.hypot(stump["x"] - centres[1][0], stump["y"] - centres[1][1]) < 0.05 and 0.15 <= stump["r"] <= 0.36
    render.render(df, "label", str(tmp_path / "a.png"), width=300)
    assert (tmp_path / "a.png").read_bytes()[:4] == b"\x89PNG" and (tmp_path / "a.png").stat().st_size > 3000
    marks = spark.createDataFrame([(float(x), float(y)) for x, y in centres], "x double, y double")
    render.render(df, "label", str(tmp_path / "c.png"), width=300, classes=["ground", "stump", "other"], instances=marks)
    assert (tmp_path / "c.png").read_bytes() != (tmp_path / "a.png").read_bytes() and b"stump" in (tmp_path / "c.png.json").read_bytes()
    with pytest.raises(KeyError):
        render.render(df, "nothing", str(tmp_path / "b.png"))


def test_streaming_columns(spark, tmp_path):
    spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), F.lit(0.5).alias("y"), F.col("id").cast("double").alias("z")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double, z double").parquet(str(tmp_path / "in"))
    q = counts.column_summary(stream, 5).writeStream.format("memory").queryName("cols").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["i"], r["n"], r["high"]) for r in spark.sql("select * from cols").collect()) == [(0, 50, 94.0), (1, 50, 99.0)]
