"""The end-to-end demonstration on two synthetic plots, and registration from files."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from standscan.operators import clusters, metrics, points, raster, register, render
from standscan.plans import config as configs
from standscan.plans import pipeline
from standscan.sources import clouds, sinks, synthetic

# The lenient stump rules used to find registration targets.
LOOSE = {"min_hag": 0.05, "max_hag": 1.5, "max_stack_hag": 1.8, "eps": 0.1, "min_samples": 8, "min_points": 30, "height": [0.1, 1.0], "diameter": [0.25, 2.5], "min_roundness": 0.3, "max_slenderness": 10.0, "max_scattering": 1.0}


def register_files(spark: SparkSession, annotations, target: str, output: str, voxel: float = 0.03) -> dict:
    """Align one annotation file per object to a survey and save the 4x4 matrix."""
    paths = clouds.expand_paths(spark, annotations)
    src = clouds.read_clouds(spark, paths)
    centres = [(r["x"], r["y"]) for r in src.groupBy("file_ix").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("file_ix").collect()]
    dst = points.voxel_downsample(clouds.read_cloud(spark, target), voxel)
    low = points.column_features(raster.fit_terrain(dst).add_height(dst), 0.5, 0.4)
    _, stats = clusters.detect_stumps(low, LOOSE)
    found = np.array([(r["x"], r["y"]) for r in stats.where("accepted").collect()]).reshape(-1, 2)
    matrix, scores = register.register_clouds(centres, found, points.voxel_downsample(src, 0.05), dst)
    sinks.save_transform(matrix, output)
    return scores


def run_demo(spark: SparkSession, work_dir: str, size: float = 40, stumps: int = 40, shrubs: int = 20, trees: int = 6, density: float = 400, texts=()) -> dict:
    """Train on plot A without labels, label plot B, and score it against the truth."""
    os.makedirs(work_dir, exist_ok=True)
    paths = []
    for seed, name in ((0, "plot_a"), (1, "plot_b")):
        cloud, centres = synthetic.make_forest(spark, size, stumps, shrubs, trees, density, seed)
        paths.append(os.path.join(work_dir, f"{name}.ply"))
        sinks.write_ply(cloud, paths[-1])
    config = configs.load(None, texts, {"name": "demo", "work_dir": work_dir, "data": {"inputs": [paths[0]], "voxel_size": 0.05}})
    pipeline.extract(spark, config)
    pipeline.pseudolabel(spark, config)
    pipeline.split_scenes(spark, config)
    run = pipeline.train(spark, config)
    pipeline.evaluate(spark, run)
    out_path = os.path.join(work_dir, "plot_b_pred.ply")
    pipeline.predict(spark, run, [paths[1]], out_path, full_resolution=True)
    truth, pred = clouds.read_cloud(spark, paths[1]), clouds.read_cloud(spark, out_path)
    scored = pred.select("pid", "pred").join(truth.select("pid", F.col("label").alias("target")), "pid")
    true_centres = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], "id long, x double, y double")
    found = metrics.instance_centres(pred)
    summary = {
        "checkpoint": run,
        "plot_b_points": metrics.summarise(metrics.confusion(scored), 3),
        "plot_b_stumps": metrics.detection_scores(true_centres.count(), found.count(), metrics.match_centres(true_centres, found, 0.75).count()),
    }
    classes = config["pseudolabel"]["classes"]
    instances = spark.read.csv(os.path.splitext(out_path)[0] + "_instances.csv", header=True, inferSchema=True)
    render.render(pred, "pred", os.path.join(work_dir, "plot_b_prediction.png"), classes=classes, instances=instances)
    render.render(truth, "label", os.path.join(work_dir, "plot_b_truth.png"), classes=classes)
    sinks.write_json(summary, os.path.join(work_dir, "demo_summary.json"))
    return summary
