"""Rule-based labels, painting of reference annotations, and comparison with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.operators.clusters import detect_stumps
from standscan.operators.metrics import confusion, summarise
from standscan.operators.neighbours import nearest_within, pairs_within, within_radius
from standscan.operators.points import IGNORE, voxel_downsample
from standscan.session import materialise

# The default thresholds of the labelling rules.
DEFAULTS = {
    "classes": ["ground", "stump", "other"],
    "ground_max_hag": 0.12,
    "ignore_band": 0.08,
    "stump": {
        "min_hag": 0.05,
        "max_hag": 1.5,
        "max_stack_hag": 1.0,
        "eps": 0.08,
        "min_samples": 8,
        "min_points": 80,
        "height": [0.12, 0.8],
        "diameter": [0.3, 2.5],
        "min_roundness": 0.3,
        "max_slenderness": 4.0,
        "max_scattering": 0.25,
    },
    "stumps_from_reference": False,
}


def rule_labels(points: DataFrame, classes: Sequence[str], ground_max, band, instance: str = "instance") -> DataFrame:
    """Append ``label``: stump instances first, then ground, the ignored band, and other."""
    hag = F.col("hag")
    label = F.when(F.col(instance) >= 0, classes.index("stump")) if "stump" in classes else F.when(F.lit(False), 0)
    label = label.when(hag < ground_max, classes.index("ground")).when(hag < ground_max + band, IGNORE).otherwise(classes.index("other"))
    return points.withColumn("label", label.cast("int"))


def pseudo_label(points: DataFrame, config: Mapping, scale: int = 20) -> tuple[DataFrame, DataFrame | None]:
    """``points`` with ``label`` and ``instance``, and the table of stump candidates."""
    stats = None
    if "stump" in config["classes"]:
        instance, stats = detect_stumps(points, config["stump"], f"scattering_k{scale}")
        points = points.join(instance, "pid")
    else:
        points = points.withColumn("instance", F.lit(-1).cast("bigint"))
    return rule_labels(points, config["classes"], config["ground_max_hag"], config["ignore_band"]), stats


def stumps_from_reference(points: DataFrame, ref_stump: int, stump: int, other: int) -> DataFrame:
    """Replace the rules' stumps and instances by those of the reference."""
    label = F.when(F.col("ref_label") == ref_stump, stump).when(F.col("label") == stump, other).otherwise(F.col("label"))
    return points.withColumns({"label": label.cast("int"), "instance": F.col("ref_instance")})


class Source(NamedTuple):
    """An annotated cloud, the number of its class, and how it is painted."""

    cloud: DataFrame
    label: int
    radius: float
    min_hag: float | None = None
    instances: bool = False  # each file, by ``file_ix``, is one object


def paint_reference(points: DataFrame, sources: Sequence[tuple], default: int = IGNORE) -> DataFrame:
    """Append ``ref_label``, the class of the last source with a point within its radius, and ``ref_instance``.

    ``sources`` are :class:`Source` or tuples of its first fields. A source is thinned at half
    its radius first; with ``min_hag`` it paints only points of at least that height. Objects
    are numbered in the order of sources and files, and the last one that reaches a point owns it.
    """
    hits, numbered = None, 0
    for order, source in enumerate(Source(*s) for s in sources):
        open_points = points if source.min_hag is None else points.where(F.col("hag") >= source.min_hag)
        number = F.lit(None).cast("bigint")
        if source.instances:
            thin = voxel_downsample(source.cloud, source.radius / 2, by=("file_ix",))
            near = pairs_within(open_points, thin, source.radius).join(thin.select(F.col("pid").alias("nid"), "file_ix"), "nid").select("pid", "file_ix").distinct()
            number = (F.col("file_ix") + numbered).cast("bigint")
            numbered += (source.cloud.agg(F.max("file_ix").alias("m")).first()["m"] or 0) + 1
        else:
            near = within_radius(open_points, voxel_downsample(source.cloud, source.radius / 2), source.radius)
        found = near.select("pid", F.lit(order).alias("o"), F.lit(source.label).alias("l"), number.alias("n"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return points.withColumns({"ref_label": F.lit(default), "ref_instance": F.lit(-1).cast("bigint")})
    last = hits.groupBy("pid").agg(F.max(F.struct("o", "l")).alias("h"), F.max("n").alias("n")).select("pid", F.col("h.l").alias("ref_label"), F.col("n").alias("ref_instance"))
    return points.join(last, "pid", "left").withColumns({"ref_label": F.coalesce("ref_label", F.lit(default)).cast("int"), "ref_instance": F.coalesce("ref_instance", F.lit(-1).cast("bigint"))})


def map_classes(df: DataFrame, class_map: Mapping[int, int], source: str, out: str) -> DataFrame:
    """Append ``out``: the reference class of ``source``; null for classes that the map lacks."""
    table = F.create_map(*[F.lit(v) for pair in class_map.items() for v in pair]).cast("map<int,int>")
    return df.withColumn(out, F.try_element_at(table, F.col(source)))


def reference_report(points: DataFrame, class_map: Mapping[int, int], n_classes: int, label: str = "label") -> dict:
    """Agreement of ``label`` with ``ref_label`` on the points that have a label, through ``class_map``."""
    mapped = map_classes(points.where(F.col(label) != IGNORE), class_map, label, "ss_mapped")
    ignored = points.agg(F.avg((F.col(label) == IGNORE).cast("double")).alias("i")).first()["i"]
    return {"points": summarise(confusion(mapped, "ref_label", "ss_mapped"), n_classes), "ignored_fraction": ignored or 0.0}


def compare_with_reference(points: DataFrame, reference: DataFrame, class_map: Mapping[int, int], n_classes: int, tolerance: float = 0.02) -> dict:
    """Agreement with the nearest reference point closer than ``tolerance``."""
    found = reference.withColumn("target", F.col("label"))
    joined = materialise(nearest_within(points, found, tolerance, keep=["label"], fields=["target"]).select("label", "nid", "target"), "reference-near")
    scored = map_classes(joined.where(F.col("nid").isNotNull() & (F.col("label") != IGNORE)), class_map, "label", "pred").select("target", "pred")
    report = summarise(confusion(scored), n_classes)
    shares = joined.agg(F.avg(F.col("nid").isNotNull().cast("double")).alias("m"), F.avg((F.col("label") == IGNORE).cast("double")).alias("i")).first()
    return report | {"matched_fraction": shares["m"], "ignored_fraction": shares["i"]}
