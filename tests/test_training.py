from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from standscan.functions.cloud import portable_hash
from standscan.operators import blocks, metrics, models
from standscan.operators.render import render_curves

MLP = {"hidden": [4], "rounds": 4, "iterations": 3, "samples": 12, "points": 40, "balanced": True, "vary": True, "val_every": 1, "patience": 4}


@pytest.fixture(scope="module")
def cloud(spark):
    """Points whose class shows in ``a``; one in ten has no label, and one class is rare."""
    draw = lambda seed: portable_hash("pid", seed) % 1000
    df = spark.range(1500).withColumnRenamed("id", "pid").withColumns({"x": draw(1) / 100.0, "y": draw(2) / 100.0, "z": draw(3) / 1000.0})
    label = F.when(F.col("pid") % 10 == 0, -1).when(F.col("pid") % 10 == 1, 2).otherwise((F.col("pid") % 2).cast("int")).cast("int")
    return df.withColumn("label", label).withColumn("a", (F.col("label") + draw(4) / 4000.0).cast("float"))


@pytest.fixture(scope="module")
def weights(cloud):
    return metrics.class_weights(cloud)


def test_a_perceptron_goes_on_where_the_last_round_ended(cloud, weights):
    told = []
    done = models.train_in_rounds(cloud, cloud, ["a"], weights, "mlp", MLP, 5.0, 3, tell=told.append)
    assert told == done.history and [r["round"] for r in told] == [1, 2, 3, 4]
    loss = [r["train_loss"] for r in told]
    assert loss[-1] < 0.9 * loss[0]
    assert max(r["val_miou"] for r in told) > told[0]["val_miou"] or told[0]["val_miou"] == 1.0
    # Steps of a single round from the same start do not come as far.
    once = models.train_in_rounds(cloud, cloud, ["a"], weights, "mlp", MLP | {"rounds": 1}, 5.0, 3)
    assert once.history[0]["train_loss"] == pytest.approx(loss[0]) and list(once.best.weights) == list(once.last.weights)


def test_training_stops_when_validation_stays(cloud, weights):
    wrong = cloud.withColumn("label", F.when(F.col("label") >= 0, 7).otherwise(-1).cast("int"))
    done = models.train_in_rounds(cloud, wrong, ["a"], weights, "mlp", MLP | {"rounds": 6, "patience": 2, "iterations": 1}, 5.0, 8)
    assert [r["val_miou"] for r in done.history] == [0.0, 0.0, 0.0]
    assert list(done.best.weights) != list(done.last.weights)


def test_training_without_validation_or_labels(cloud, weights):
    done = models.train_in_rounds(cloud, cloud.withColumn("label", F.lit(-1)), ["a"], weights, "mlp", MLP | {"rounds": 2, "val_every": 2, "patience": 1}, 5.0, 3)
    assert "val_miou" not in done.history[0] and done.history[1]["val_miou"] is None and list(done.best.weights) == list(done.last.weights)
    with pytest.raises(ValueError):
        models.train_in_rounds(cloud.withColumn("label", F.lit(None).cast("int")), cloud, ["a"], weights, "mlp", MLP, 5.0, 3)


def test_a_forest_takes_all_points_at_once(cloud, weights):
    done = models.train_in_rounds(cloud, cloud, ["a"], weights, "forest", {"trees": 3, "depth": 4}, 5.0, 3)
    assert len(done.history) == 1 and done.history[0]["val_miou"] > 0.99 and done.history[0]["train_oa"] > 0.99


def test_rows_are_repeated_by_weight(spark, cloud):
    weights = spark.createDataFrame([(0, 0.25), (1, 2.5)], "label int, weight double")
    got = {r["label"]: r["count"] for r in models.repeated(cloud, weights, F.col("pid")).groupBy("label").count().collect()}
    rows = {r["label"]: r["count"] for r in cloud.groupBy("label").count().collect()}
    assert set(got) == {0, 1}
    assert got[0] / rows[0] == pytest.approx(0.25, abs=0.06) and got[1] / rows[1] == pytest.approx(2.5, abs=0.06)
    again = models.repeated(cloud.repartition(7), weights, F.col("pid"))
    assert sorted(r["pid"] for r in again.collect()) == sorted(r["pid"] for r in models.repeated(cloud, weights, F.col("pid")).collect())
    assert again.where("label = 1").groupBy("pid").count().agg(F.min("count"), F.max("count")).first()[:] == (2, 3)
    assert again.columns == cloud.columns or set(again.columns) == set(cloud.columns)
    assert blocks.train_blocks(cloud, 5.0, 16, 3).groupBy("sample").count().where("count <> 16").count() == 0


def test_curves_of_any_history(tmp_path):
    for history in ([], [{"round": 1, "train_loss": 2.0, "train_miou": None}], [{"round": i, "train_loss": 1.0 / i, "train_miou": 0.1 * i, "val_miou": 0.05 * i} for i in range(1, 9)]):
        render_curves(history, str(tmp_path / "c.png"))
        assert open(tmp_path / "c.png", "rb").read(4) == b"\x89PNG"
