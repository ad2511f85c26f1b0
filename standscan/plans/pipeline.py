"""Stages from raw clouds to labels, models and inventories. Each stage reads and writes Parquet."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Mapping

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standscan.functions.cloud import argmax
from standscan.operators import clusters, labels, metrics, models, neighbours, points, raster, shape, split
from standscan.operators.render import render_confusion, render_curves
from standscan.plans import config as configs
from standscan.session import materialise
from standscan.sources import clouds, sinks

log = logging.getLogger("standscan")
SPLITS = ("train", "val", "test")
COLUMN_FEATURES = ("hag", "column_max_hag", "column_stack_hag", "column_rel_height")


def feature_names(settings: Mapping) -> list[str]:
    return sorted([*COLUMN_FEATURES, *[f"{f}_k{k}" for k in settings["scales"] for f in shape.FEATURES]])


def featurise(cloud: DataFrame, settings: Mapping) -> DataFrame:
    """Height above ground, column features and shape features of every scale."""
    dtm = settings["dtm"]
    terrain = raster.fit_terrain(cloud, dtm["cell"], dtm["windows"], dtm["dh0"], dtm["slope"], dtm["smooth"])
    high = materialise(terrain.add_height(cloud), "features-hag")
    high = points.column_features(high, settings["column_cell"], settings["column_gap"])
    high = high.withColumns({c: F.col(c).cast("float") for c in ("column_max_hag", "column_stack_hag")})
    return shape.shape_features(materialise(high, "features-columns"), list(settings["scales"]), 0.1)


def _path(config: Mapping, *names: str) -> str:
    return os.path.join(config["work_dir"], *names)


def load_and_featurise(spark: SparkSession, config: Mapping, inputs=None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(the raw cloud, its thinned points with features)``."""
    raw = clouds.read_clouds(spark, inputs or config["data"]["inputs"], config["data"]["bounds"])
    # Attributes of the file give way to the columns that the stages add.
    made = ["label", "instance", "pred", "ref_label", *feature_names(config["features"])]
    raw = raw.withColumnsRenamed({c: f"input_{c}" for c in raw.columns if c in made})
    thin = materialise(points.voxel_downsample(raw, config["data"]["voxel_size"], seed), "thinned")
    return raw, featurise(thin, config["features"])


def class_map(config: Mapping) -> dict[int, int]:
    """Class numbers of the labels to those of the reference, by the names that the setting gives."""
    names, to = config["pseudolabel"]["classes"], config["reference"]["classes"]
    given = config["reference"].get("class_map") or {c: c for c in names if c in to}
    return {i: to.index(given[c]) for i, c in enumerate(names) if c in given}


def _detection(truth: DataFrame, found: DataFrame, reach: float = 0.75) -> dict:
    """Scores of object centres of ``found`` against those of ``truth``."""
    refs, preds = materialise(metrics.instance_centres(truth), "centres"), materialise(metrics.instance_centres(found), "centres")
    return metrics.detection_scores(refs.count(), preds.count(), metrics.match_centres(refs, preds, reach).count())


def extract(spark: SparkSession, config: Mapping) -> DataFrame:
    _, df = load_and_featurise(spark, config)
    sources = []
    for source in (config["reference"] or {}).get("sources", []):
        cloud = clouds.read_clouds(spark, source["path"])
        if source.get("transform"):
            cloud = points.rigid_transform(cloud, sinks.load_transform(source["transform"]).tolist())
        sources.append(labels.Source(cloud, config["reference"]["classes"].index(source["class"]), source.get("radius", 0.02), source.get("min_hag"), source.get("instances", False)))
    if sources:
        default = config["reference"].get("default_class")
        df = labels.paint_reference(df, sources, config["reference"]["classes"].index(default) if default else points.IGNORE)
    df.write.mode("overwrite").parquet(_path(config, "features"))
    return spark.read.parquet(_path(config, "features"))


def pseudolabel(spark: SparkSession, config: Mapping) -> dict:
    df, rules = spark.read.parquet(_path(config, "features")), config["pseudolabel"]
    field = config["data"]["label_field"]
    if field:
        field = field if field in df.columns else f"input_{field}"
        mapping = {k: rules["classes"].index(v) for k, v in config["data"]["label_map"].items()}
        out, stats = points.remap_labels(df, mapping, field).withColumn("instance", F.lit(-1).cast("bigint")), None
    else:
        out, stats = labels.pseudo_label(df, rules, config["features"]["scales"][0])
        if rules["stumps_from_reference"]:
            if "ref_label" not in out.columns:
                raise ValueError("stumps_from_reference needs a reference with sources")
            out = labels.stumps_from_reference(out, config["reference"]["classes"].index("stump"), rules["classes"].index("stump"), rules["classes"].index("other"))
    out.write.mode("overwrite").parquet(_path(config, "labels"))
    if stats is not None:
        sinks.write_csv(stats.orderBy("id"), _path(config, "stump_candidates.csv"))
    out = spark.read.parquet(_path(config, "labels"))
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    report = {"ignored": counts.get(points.IGNORE, 0)} | {c: counts.get(i, 0) for i, c in enumerate(rules["classes"])}
    if "ref_label" in out.columns:
        report["vs_reference"] = labels.reference_report(out, class_map(config), len(config["reference"]["classes"]))
        if not out.where("ref_instance >= 0").isEmpty() and not out.where("instance >= 0").isEmpty():
            report["vs_reference"]["instances"] = _detection(out.select("x", "y", F.col("ref_instance").alias("instance")), out)
    sinks.write_json(report, _path(config, "pseudolabel_report.json"))
    return report


def split_scenes(spark: SparkSession, config: Mapping) -> dict:
    s = config["split"]
    names = config["model"]["input_features"] or feature_names(config["features"])
    done = split.spatial_split(spark.read.parquet(_path(config, "labels")), s["tile"], s["ratios"], s["seed"])
    done.write.mode("overwrite").partitionBy("split").parquet(_path(config, "scenes"))
    done = spark.read.parquet(_path(config, "scenes"))
    train = done.where("split = 0")
    stats = {r["feature"]: (r["mean"], r["std"]) for r in points.feature_stats(train, names).collect()}
    weights = {r["label"]: r["weight"] for r in metrics.class_weights(train, mode=config["train"]["class_weights"]).collect()}
    counts = {f"{SPLITS[r['split']]}/{r['label']}": r["count"] for r in done.groupBy("split", "label").count().collect()}
    meta = {"classes": config["pseudolabel"]["classes"], "feature_names": names, "stats": stats, "class_weights": weights, "counts": counts}
    sinks.write_json(meta, _path(config, "meta.json"))
    return meta


def train(spark: SparkSession, config: Mapping) -> str:
    """Fit the configured model in rounds and save the best and the last with their settings. Returns the run's folder.

    ``metrics.csv`` has a row a round and is written after each; ``best_val.json`` holds the best of them, ``curves.png`` shows all.
    """
    with open(_path(config, "meta.json")) as f:
        meta = json.load(f)
    names, classes, t = meta["feature_names"], meta["classes"], config["train"]
    scenes = points.standardise(spark.read.parquet(_path(config, "scenes")), meta["stats"])
    weights = spark.createDataFrame([(int(k), float(v)) for k, v in meta["class_weights"].items()], "label int, weight double")
    name = config["model"]["name"]
    run = _path(config, "runs", f"{name}-{time.strftime('%Y%m%d-%H%M%S')}")
    os.makedirs(run, exist_ok=True)
    configs.save(config, os.path.join(run, "config.yaml"))
    sinks.write_json(meta, os.path.join(run, "meta.json"))
    history = []

    def tell(row: dict) -> None:
        history.append({(f"val_iou_{classes[int(k[8:])]}" if k.startswith("val_iou_") else k): v for k, v in row.items()})
        sinks.write_rows(history, os.path.join(run, "metrics.csv"))
        log.info("round %d: %s", row["round"], json.dumps(history[-1]))

    done = models.train_in_rounds(scenes.where("split = 0"), scenes.where("split = 1"), names, weights, name, config["model"].get(name, {}), t["block_size"], len(classes), t["seed"], config["infer"]["stride"], tell)
    for folder, model in (("model", done.best), ("last", done.last)):
        model.write().overwrite().save(os.path.abspath(os.path.join(run, folder)))
    seen = [row for row in history if row.get("val_miou") is not None]
    sinks.write_json(max(seen, key=lambda row: row["val_miou"]) if seen else {}, os.path.join(run, "best_val.json"))
    render_curves(history, os.path.join(run, "curves.png"))
    return run


def load_run(run: str):
    """``(model, config, meta)`` of a saved run."""
    config = configs.load(os.path.join(run, "config.yaml"))
    with open(os.path.join(run, "meta.json")) as f:
        meta = json.load(f)
    kind = {"forest": RandomForestClassificationModel, "mlp": MultilayerPerceptronClassificationModel}[config["model"]["name"]]
    return kind.load(os.path.abspath(os.path.join(run, "model"))), config, meta


def infer(df: DataFrame, model, config: Mapping, meta: Mapping, settings: Mapping) -> tuple[DataFrame, DataFrame | None]:
    """Votes, smoothing, classes and instances of featurised points."""
    n = len(meta["classes"])
    probs = [f"prob_{c}" for c in range(n)]
    scene = points.standardise(df, meta["stats"])
    voted = models.predict(scene, model, meta["feature_names"], config["train"]["block_size"], settings["stride"], n)
    home = df.select("pid", "x", "y", "z", "hag")
    smooth = neighbours.smooth(materialise(home.join(voted, "pid"), "infer-votes"), settings["smooth_k"], 0.1, probs)
    out = materialise(home.join(smooth, "pid").withColumn("pred", argmax(F.array(*probs))), "infer-pred")
    wanted = settings["instances"]
    if not wanted or wanted["class"] not in meta["classes"]:
        return out.withColumn("instance", F.lit(-1).cast("bigint")), None
    instance, stats = clusters.extract_instances(out, meta["classes"].index(wanted["class"]), wanted["eps"], wanted["min_points"])
    return out.join(instance, "pid"), stats


def evaluate(spark: SparkSession, run: str, part: str = "test", settings: Mapping | None = None) -> dict:
    """Scores of a run on one split, against the rule labels and, if painted, the reference."""
    model, config, meta = load_run(run)
    scene = spark.read.parquet(_path(config, "scenes")).where(F.col("split") == SPLITS.index(part))
    out, stats = infer(scene, model, config, meta, settings or config["infer"])
    out = materialise(out, "evaluated")
    scored = materialise(out.join(scene.select("pid", F.col("label").alias("target"), *[c for c in ("ref_label",) if c in scene.columns]), "pid"), "evaluated-scored")
    report = {"checkpoint": run, "split": part, "vs_pseudolabels": metrics.summarise(metrics.confusion(scored), len(meta["classes"]))}
    folder = os.path.join(run, f"eval_{part}")
    os.makedirs(folder, exist_ok=True)
    tables = [("pseudolabels", report["vs_pseudolabels"], meta["classes"])]
    if stats is not None and "instance" in scene.columns:
        report["instances"] = _detection(scene, out)
    if "ref_label" in scene.columns:
        mapping, n = class_map(config), len(config["reference"]["classes"])
        report["vs_reference"] = metrics.summarise(metrics.confusion(labels.map_classes(scored, mapping, "pred", "ss_mapped"), "ref_label", "ss_mapped"), n)
        report["pseudolabels_vs_reference"] = labels.reference_report(scene, mapping, n)["points"]
        tables.append(("reference", report["vs_reference"], config["reference"]["classes"]))
        if stats is not None and not scene.where("ref_instance >= 0").isEmpty():
            report["instances_vs_reference"] = _detection(scene.select("x", "y", F.col("ref_instance").alias("instance")), out)
    for name, table, classes in tables:
        render_confusion(table["confusion_matrix"], os.path.join(folder, f"confusion_vs_{name}.png"))
        with open(os.path.join(folder, f"metrics_vs_{name}.txt"), "w") as f:
            f.write(metrics.as_text(table, classes) + "\n")
    if stats is not None:
        sinks.write_csv(stats.orderBy("id"), os.path.join(folder, "instances.csv"))
    sinks.write_json(report, os.path.join(folder, "report.json"))
    sinks.write_ply(out.drop("file_ix"), os.path.join(folder, f"{part}_pred.ply"))
    return report


def predict(spark: SparkSession, run: str, inputs, output: str, full_resolution: bool = False, texts=()) -> dict:
    """Label a new cloud with a saved run and write it with its inventory.

    ``texts`` are ``a.b=value`` settings over those of the run.
    """
    model, config, meta = load_run(run)
    config = configs.with_settings(config, texts)
    raw, df = load_and_featurise(spark, config, inputs)
    df = materialise(df, "predict-features")
    out, stats = infer(df, model, config, meta, config["infer"])
    if full_resolution:
        fields = [c for c in out.columns if c not in ("pid", "x", "y", "z")]
        out = neighbours.transfer_nearest(raw.select("pid", "x", "y", "z"), materialise(out, "predict-thin"), fields, max(config["data"]["voxel_size"] or 0.03, 0.01))
    out = materialise(out, "predicted")
    count = sinks.write_cloud(out, output, "pred")
    if stats is not None:
        sinks.write_csv(stats.orderBy("id"), os.path.splitext(output)[0] + "_instances.csv")
    return {"points": count} | {meta["classes"][r["pred"]]: r["count"] for r in out.groupBy("pred").count().collect()}
