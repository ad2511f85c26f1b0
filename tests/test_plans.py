from __future__ import annotations

import csv
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.plans import cli, config, demo, pipeline
from standscan.sources import clouds, sinks, synthetic


@pytest.fixture(scope="module")
def plot(spark, tmp_path_factory):
    """A small plot, an annotation file for each stump, and a configuration that names them."""
    folder = tmp_path_factory.mktemp("plot")
    cloud, centres = synthetic.make_forest(spark, 20, 7, 1, 1, 60, 3)
    sinks.write_ply(cloud.drop("label", "instance"), str(folder / "plot.ply"))
    for i in range(len(centres)):
        sinks.write_ply(cloud.where(f"instance = {i}").select("pid", "x", "y", "z"), str(folder / f"stump_{i}.ply"))
    reference = {
        "classes": ["rest", "stump"],
        "default_class": "rest",
        "class_map": {"ground": "rest", "stump": "stump", "other": "rest"},
        "sources": [{"path": str(folder / "stump_*.ply"), "class": "stump", "radius": 0.05, "instances": True, "min_hag": 0.02}],
    }
    path = str(folder / "config.yaml")
    config.save(config.load(None, ["data.voxel_size=0.08", "features.scales=[10]", "model.forest.trees=5", "model.forest.depth=6", "split.tile=4.0", "infer.smooth_k=3"], {"work_dir": str(folder / "work"), "data": {"inputs": [str(folder / "plot.ply")]}, "reference": reference}), path)
    return folder, path, centres


def test_stages_from_files_to_scores(spark, plot, monkeypatch):
    folder, path, centres = plot
    monkeypatch.setattr("standscan.session.build_session", lambda: spark)
    for command in ("extract", "pseudolabel", "split", "train"):
        assert cli.main([command, "-c", path, "--set", "pseudolabel.stumps_from_reference=true"]) == 0
    labels = spark.read.parquet(str(folder / "work" / "labels"))
    assert labels.where("instance >= 0").select("instance").distinct().count() == len(centres)
    assert labels.where("(label = 1) <> (ref_label = 1)").count() == 0 and labels.where("ref_label = 1 and hag < 0.02").count() == 0
    report = json.load(open(folder / "work" / "pseudolabel_report.json"))
    assert report["vs_reference"]["points"]["per_class"][1]["iou"] == 1.0 and report["vs_reference"]["instances"]["f1"] == 1.0
    run = str(next((folder / "work" / "runs").iterdir()))
    assert cli.main(["evaluate", "-c", path, "--checkpoint", run, "--split", "train"]) == 0
    report = json.load(open(os.path.join(run, "eval_train", "report.json")))
    assert set(report) >= {"vs_pseudolabels", "vs_reference", "pseudolabels_vs_reference", "instances_vs_reference"}
    assert len(report["vs_reference"]["per_class"]) == 2 and report["vs_reference"]["overall_accuracy"] > 0.8
    assert "stump" in open(os.path.join(run, "eval_train", "metrics_vs_reference.txt")).read()
    learnt = ["model.name=mlp", "model.mlp.hidden=[8]", "model.mlp.rounds=2", "model.mlp.iterations=10", "model.mlp.samples=10", "model.mlp.points=64"]
    assert cli.main(["train", "-c", path, "--set", *learnt]) == 0
    second = next((folder / "work" / "runs").glob("mlp-*"))
    rows = list(csv.DictReader(open(second / "metrics.csv")))
    assert [r["round"] for r in rows] == ["1", "2"] and all(float(r["train_loss"]) > 0 and "val_iou_stump" in r for r in rows)
    assert open(second / "curves.png", "rb").read(4) == b"\x89PNG" and (second / "last").exists()
    best, kept, _ = pipeline.load_run(str(second))
    assert best.numFeatures == len(pipeline.feature_names(kept["features"])) + 3
    out = str(folder / "labelled.las")
    cli.main(["predict", "--checkpoint", run, "--input", str(folder / "plot.ply"), "--output", out, "--set", "infer.smooth_k=0", "infer.instances=null"])
    whole = clouds.read_cloud(spark, str(folder / "plot.ply")).count()
    assert 0 < clouds.read_cloud(spark, out).count() < whole and not os.path.exists(str(folder / "labelled_instances.csv"))


@pytest.mark.skipif(not os.environ.get("STANDSCAN_LONG"), reason="takes minutes; set STANDSCAN_LONG=1")
def test_registration_from_files(spark, plot):
    folder, _, centres = plot
    turn = np.deg2rad(35)
    matrix = np.eye(4)
    matrix[:2, :2] = [[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]
    matrix[:3, 3] = (120.0, -40.0, 3.0)
    there = folder / "moved"
    there.mkdir()
    for i in range(len(centres)):
        p = clouds.read_cloud(spark, str(folder / f"stump_{i}.ply"))
        xyz = np.array([[r["x"], r["y"], r["z"]] for r in p.select("x", "y", "z").collect()]) @ matrix[:3, :3].T + matrix[:3, 3]
        np.savetxt(there / f"s{i}.txt", xyz)
    demo.register_files(spark, [str(there / "*.txt")], str(folder / "plot.ply"), str(folder / "t.txt"), voxel=0.05)
    found = sinks.load_transform(str(folder / "t.txt"))
    assert np.abs(found @ matrix - np.eye(4))[:2, :2].max() < 0.05
    moved = (found @ matrix @ np.append(centres[0], [0.0, 1.0]))[:2]
    assert np.hypot(*(moved - centres[0])) < 0.3


def test_unknown_model(spark):
    from standscan.operators import models

    with pytest.raises(ValueError):
        models.build_model("none", {}, 3, 2)
    assert pipeline.feature_names({"scales": [10]}) == sorted(pipeline.feature_names({"scales": [10]}))
