from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.operators import blocks, neighbours, register, split
from standscan.plans import config


def cloud_of(spark, n, seed=0, size=10.0, labels=(0, 1, 2)):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, rng.uniform(0, size, 3)), int(rng.choice(labels))) for i in range(n)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, label int")


def test_padded_chunks_are_full_and_lose_no_point(spark):
    rows = split.eval_blocks(cloud_of(spark, 900), 4.0, 2.0)
    made = blocks.padded_chunks(rows, 50).cache()
    assert {r["n"] for r in made.groupBy("bx", "by", "chunk").agg(F.countDistinct("slot").alias("n")).collect()} == {50}
    assert made.count() == made.select("bx", "by", "chunk", "slot").distinct().count()
    held = rows.select("bx", "by", "pid")
    assert held.exceptAll(made.select("bx", "by", "pid")).isEmpty()  # every point of a block is in a chunk
    assert made.select("bx", "by", "pid").distinct().exceptAll(held).isEmpty()  # and padding comes from the block itself
    again = blocks.padded_chunks(rows.repartition(7), 50)
    assert made.select("bx", "by", "chunk", "slot", "pid").exceptAll(again.select("bx", "by", "chunk", "slot", "pid")).isEmpty()
    assert blocks.padded_chunks(rows.limit(0), 50).count() == 0
    one = blocks.padded_chunks(rows.orderBy("pid").limit(1), 8)
    assert one.count() == 8 and one.select("pid").distinct().count() == 1


@pytest.mark.parametrize("balanced", [True, False])
def test_train_blocks_have_one_shape(spark, balanced):
    cloud = cloud_of(spark, 1500, labels=(-1, 0, 0, 0, 0, 0, 0, 0, 2)).withColumn("extra", F.col("pid") * 2)
    made = blocks.train_blocks(cloud, 3.0, 64, 40, balanced).cache()
    rows = made.toPandas()
    assert set(rows.groupby("sample").size()) == {64} and rows["sample"].nunique() == 40
    assert (rows["local_x"].abs() <= 1.5).all() and (rows["local_y"].abs() <= 1.5).all() and (rows["local_z"] >= 0).all()
    assert (rows["extra"] == 2 * rows["pid"]).all()
    points = {r["pid"]: r for r in cloud.collect()}
    centres = rows.groupby("sample")[["centre", "n", "turn"]].first()
    assert all(points[c]["label"] >= 0 for c in centres["centre"])
    rare = np.mean([points[c]["label"] == 2 for c in centres["centre"]])
    assert rare > 0.3 if balanced else rare < 0.3
    for sample, r in centres.iterrows():
        at = points[r["centre"]]
        near = {p["pid"] for p in points.values() if abs(p["x"] - at["x"]) <= 1.5 and abs(p["y"] - at["y"]) <= 1.5}
        chosen = rows[rows["sample"] == sample]
        assert len(near) == r["n"] and (r["n"] >= 128 or r["turn"] == 19) and set(chosen["pid"]) <= near
        assert len(near) < 64 or chosen["pid"].is_unique
        assert np.isclose((chosen["z"] - chosen["local_z"]).min(), min(points[p]["z"] for p in near))


def test_train_blocks_of_odd_clouds(spark):
    sparse = cloud_of(spark, 5, size=100.0)
    got = blocks.train_blocks(sparse, 1.0, 16, 3, tries=2)
    assert got.count() == 48 and got.groupBy("sample").agg(F.countDistinct("pid").alias("n")).where("n > 1").count() == 0
    for cloud in (sparse.limit(0), sparse.withColumn("label", F.lit(-1)), sparse.withColumn("label", F.lit(None).cast("int"))):
        none = blocks.train_blocks(cloud, 1.0, 16, 3)
        assert none.count() == 0 and {"sample", "slot", "local_x", "local_z"} <= set(none.columns)


def test_augmented_blocks_keep_their_shape(spark):
    made = blocks.train_blocks(cloud_of(spark, 800), 4.0, 32, 60, min_points=10)
    plain = made.orderBy("sample", "slot").toPandas()
    moved = blocks.augment(made).orderBy("sample", "slot").toPandas()
    assert moved.drop(columns=["local_x", "local_y", "local_z"]).equals(plain.drop(columns=["local_x", "local_y", "local_z"]))
    scales, signs = [], []
    for s, rows in plain.groupby("sample"):
        a, b = rows[["local_x", "local_y", "local_z"]].to_numpy(), moved[moved["sample"] == s][["local_x", "local_y", "local_z"]].to_numpy()
        fit = np.linalg.lstsq(a[:, :2], b[:, :2], rcond=None)[0]
        scales.append(np.sqrt(abs(np.linalg.det(fit))))
        signs.append(np.sign(np.linalg.det(fit)))
        assert np.abs(a @ np.block([[fit, np.zeros((2, 1))], [np.zeros((1, 2)), np.full((1, 1), scales[-1])]]) - b).max() < 0.08
    assert 0.88 < min(scales) < 0.95 and 1.05 < max(scales) < 1.12 and 10 < signs.count(1.0) < 50


def test_ball_query_and_interpolation_match_brute_force(spark):
    cloud = cloud_of(spark, 250, 3, 4.0)
    rows = {r["pid"]: np.array([r["x"], r["y"], r["z"]]) for r in cloud.collect()}
    lonely = spark.createDataFrame([(1000, 50.0, 50.0, 50.0, 0)], cloud.schema)
    got = neighbours.ball_query(cloud.where("pid < 40").unionByName(lonely), cloud, 0.7, 6).collect()
    found = {(r["pid"], r["slot"]): r["nid"] for r in got}
    assert len(found) == 240 and len(got) == 240
    for p in range(40):
        d = sorted((((rows[p] - v) ** 2).sum(), k) for k, v in rows.items())
        near = [k for v, k in d if v <= 0.49][:6]
        assert [found[p, s] for s in range(6)] == near + [near[0]] * (6 - len(near))
    targets = cloud.where("pid >= 200").withColumn("v", F.col("pid").cast("double"))
    got = {r["pid"]: r["v"] for r in neighbours.interpolate(cloud, targets, ["v"], 1.0).collect()}
    for p, at in rows.items():
        d = sorted((((at - rows[k]) ** 2).sum(), k) for k in range(200, 250))[:3]
        w = np.array([1 / (v + 1e-8) for v, _ in d])
        assert np.isclose(got[p], (w * [k for _, k in d]).sum() / w.sum())
    assert abs(got[200] - 200) < 1e-3
    two = neighbours.interpolate(cloud.limit(3), targets.where("pid < 202"), ["v"], 1.0).collect()
    assert len(two) == 3 and all(200 <= r["v"] <= 201 for r in two)


@pytest.mark.parametrize("n,apart", [(0, 0.5), (1, 0.5), (300, 0.5), (300, 3.0), (40, 100.0)])
def test_thinned_centres_equal_the_sequential_loop(spark, n, apart):
    xy = np.random.default_rng(n).uniform(0, 10, (n, 2))
    xy[n // 2 :] = np.round(xy[n // 2 :])  # repeats and ties of distance
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")
    kept = []
    for i, p in enumerate(xy):
        if all(((p - xy[k]) ** 2).sum() > apart * apart for k in kept):
            kept.append(i)
    assert sorted(r["pid"] for r in register.thin(df, apart).collect()) == kept


def test_a_chain_of_centres_is_thinned(spark):
    df = spark.range(60).select(F.col("id").alias("pid"), (F.col("id") * 0.4).alias("x"), F.lit(0.0).alias("y"))
    assert sorted(r["pid"] for r in register.thin(df, 0.5).collect()) == list(range(0, 60, 2))


def test_settings_replace_what_was_there():
    got = config.with_settings(config.DEFAULTS, ["infer.instances={}", "new.deep.name=[1, 2]", "data.bounds=null", "model.name.more=1", "model.forest={trees: 3}"])
    assert got["infer"]["instances"] == {} and got["new"]["deep"]["name"] == [1, 2] and got["data"]["bounds"] is None
    assert got["model"]["name"] == {"more": 1} and got["model"]["forest"] == {"trees": 3} and got["model"]["mlp"] == config.DEFAULTS["model"]["mlp"]
    assert config.DEFAULTS["infer"]["instances"]["class"] == "stump"
    with pytest.raises(ValueError):
        config.with_settings({}, ["nothing"])


def test_a_section_keeps_the_settings_that_are_not_given():
    got = config.with_settings(config.DEFAULTS, ["model={mlp: {rounds: 3}, forest: 5}", "split={}", "reference={path: a}"])
    assert got["model"]["mlp"] == config.DEFAULTS["model"]["mlp"] | {"rounds": 3} and got["model"]["forest"] == 5 and got["model"]["name"] == "forest"
    assert got["split"] == config.DEFAULTS["split"] and got["reference"] == {"path": "a"} and config.DEFAULTS["model"]["mlp"]["rounds"] == 20
