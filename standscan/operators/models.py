"""Point classifiers trained by Spark ML, and voted inference over sliding blocks."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import argmax
from standscan.operators import blocks as drawn
from standscan.operators import metrics, split
from standscan.session import discard, materialise

LOCAL = ("local_x", "local_y", "local_z")


def _forest(settings: Mapping, n_inputs: int, n_classes: int, seed: int):
    return RandomForestClassifier(featuresCol="ss_v", labelCol="label", weightCol="ss_w", numTrees=settings["trees"], maxDepth=settings["depth"], seed=seed)


def _mlp(settings: Mapping, n_inputs: int, n_classes: int, seed: int):
    return MultilayerPerceptronClassifier(featuresCol="ss_v", labelCol="label", layers=[n_inputs, *settings["hidden"], n_classes], maxIter=settings.get("iterations", 100), seed=seed)


MODELS = {"forest": _forest, "mlp": _mlp}


def build_model(name: str, settings: Mapping, n_inputs: int, n_classes: int, seed: int = 0):
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {sorted(MODELS)}")
    return MODELS[name](settings, n_inputs, n_classes, seed)


def block_inputs(points: DataFrame, block: float, stride: float | None = None) -> DataFrame:
    """Points by covering block, with coordinates local to the block: its centre and its lowest point."""
    stride = stride or block
    low = points.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    blocks = split.eval_blocks(points, block, stride, 1e-6)
    floor = blocks.groupBy("bx", "by").agg(F.min("z").alias("ss_floor"))
    joined = blocks.join(floor, ["bx", "by"])
    centre = lambda c, b: F.lit(float(low[c] or 0.0) + block / 2) + F.col(b) * F.lit(float(stride))
    return joined.withColumns({"local_x": (F.col("x") - centre("x", "bx")).cast("float"), "local_y": (F.col("y") - centre("y", "by")).cast("float"), "local_z": (F.col("z") - F.col("ss_floor")).cast("float")}).drop("ss_floor")


def vectors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    filled = df.withColumns({n: F.coalesce(F.nanvl(F.col(n), F.lit(0.0).cast("float")), F.lit(0.0)).cast("float") for n in names})
    return VectorAssembler(inputCols=list(names), outputCol="ss_v").transform(filled)


def train(points: DataFrame, names: Sequence[str], weights: DataFrame, model):
    """Fit on the labelled points, weighted by class."""
    known = points.where(F.col("label") >= 0).join(F.broadcast(weights.select("label", F.col("weight").alias("ss_w"))), "label")
    return model.fit(vectors(known, names))


def repeated(rows: DataFrame, weights: DataFrame, key, seed: int = 0) -> DataFrame:
    """Each row as often as its class weighs, for models without weights of their own.

    A weight of 2.3 gives two copies, and a third where the hash of ``key`` says so, in three of ten
    rows. Rows of a class without a weight, and those without a class, are left out.
    """
    weighed = rows.join(F.broadcast(weights.select("label", F.col("weight").alias("ss_w"))), "label")  # a row a class
    copies = F.floor(F.col("ss_w") + drawn.portion(drawn.rehash(key, seed))).cast("int")
    return weighed.withColumn("ss_copies", copies).where("ss_copies > 0").withColumn("ss_copies", F.explode(F.sequence(F.lit(1), "ss_copies"))).drop("ss_w", "ss_copies")


def _vote(inputs: DataFrame, model, n_classes: int) -> DataFrame:
    p = vector_to_array("probability")
    votes = model.transform(inputs).select("pid", *[F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)).alias(f"prob_{c}") for c in range(n_classes)])
    return split.average_votes(votes, [f"prob_{c}" for c in range(n_classes)])


def predict(points: DataFrame, model, names: Sequence[str], block: float, stride: float | None, n_classes: int) -> DataFrame:
    """``(pid, prob_0, ..., prob_n)`` averaged over the blocks that cover a point."""
    return _vote(vectors(block_inputs(points, block, stride or block / 2), [*LOCAL, *names]), model, n_classes)


class Training(NamedTuple):
    """The model of the best round, that of the last one, and a row of figures for each round."""

    best: object
    last: object
    history: list[dict]


def _fit_scores(inputs: DataFrame, model, n_classes: int) -> tuple[float | None, dict]:
    """``(mean logarithmic loss, summary)`` of the rows that a model was fitted on, in one pass."""
    p = vector_to_array("probability")
    scored = model.transform(inputs).select(F.col("label").alias("target"), p.alias("p"))
    loss = -F.log(F.greatest(F.coalesce(F.get("p", F.col("target")), F.lit(0.0)), F.lit(1e-12)))
    counts = materialise(scored.groupBy("target", argmax(F.col("p")).alias("pred")).agg(F.count("*").alias("n"), F.sum(loss).alias("loss")), "train-scores")
    whole = counts.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    summary = metrics.summarise(counts, n_classes)
    discard(counts)
    return (whole["loss"] / whole["n"] if whole["n"] else None), summary


def _round_inputs(points: DataFrame, names: Sequence[str], weights: DataFrame, settings: Mapping, block: float, seed: int) -> DataFrame:
    """The training rows of one round: newly drawn and varied blocks, repeated by class weight."""
    size = settings["points"]
    fresh = drawn.train_blocks(points.select("pid", "x", "y", "z", "label", *names), block, size, settings["samples"], settings["balanced"], seed=seed)
    if settings["vary"]:
        fresh = drawn.augment(fresh, seed=seed)
    labelled = repeated(fresh.where("label >= 0"), weights, F.col("sample") * size + F.col("slot"), seed)
    return labelled.select("label", *LOCAL, *names)


def train_in_rounds(points: DataFrame, val: DataFrame, names: Sequence[str], weights: DataFrame, name: str, settings: Mapping, block: float, n_classes: int, seed: int = 0, stride: float | None = None, tell: Callable[[dict], None] | None = None) -> Training:
    """Fit in rounds and keep the model with the best mean IoU on ``val``.

    A perceptron starts each round at the weights of the one before and takes ``iterations`` steps on
    ``samples`` newly drawn, varied blocks of ``points`` points each. Every ``val_every`` rounds, and in the last one, it labels
    all of ``val`` by voted blocks. After ``patience`` rounds without a better mean IoU it stops; of equal rounds the first is best.
    A forest has no weights to start from and takes all points in a single round.

    ``tell`` gets the row of each round. Without a labelled point in ``val`` there is no early stop and the last
    model is the best. Without labelled points in ``points`` a ``ValueError`` is raised.
    """
    if points.where("label >= 0").isEmpty():
        raise ValueError("there are no labelled points to train on")
    inputs, rounds = [*LOCAL, *names], settings.get("rounds", 1)
    judged = materialise(vectors(block_inputs(val, block, stride or block / 2), inputs).select("pid", "ss_v"), "train-val")
    truth = val.where("label >= 0").select("pid", F.col("label").alias("target"))
    model = best = None
    top, idle, history = None, 0, []
    for number in range(1, rounds + 1):
        started = time.monotonic()
        fit = build_model(name, settings, len(inputs), n_classes, seed)
        if name == "mlp":
            rows = materialise(_round_inputs(points, names, weights, settings, block, seed + number), "train-rows")
            if model is not None:
                fit = fit.setInitialWeights(model.weights)
            ready = vectors(rows, inputs)
            model = fit.fit(ready)
        else:
            rows = materialise(block_inputs(points, block), "train-rows")
            ready = vectors(rows.where("label >= 0"), inputs)
            model = train(rows, inputs, weights, fit)
        loss, fitted = _fit_scores(ready, model, n_classes)
        discard(rows)
        row = {"round": number, "train_loss": loss, "train_miou": fitted["miou"], "train_oa": fitted["overall_accuracy"]}
        if number % settings.get("val_every", 1) == 0 or number == rounds:
            votes = _vote(judged, model, n_classes).withColumn("pred", argmax(F.array(*[f"prob_{c}" for c in range(n_classes)])))
            scores = metrics.summarise(metrics.confusion(truth.join(votes, "pid")), n_classes)
            row |= {"val_miou": scores["miou"], "val_oa": scores["overall_accuracy"]} | {f"val_iou_{c}": s["iou"] for c, s in enumerate(scores["per_class"])}
            if scores["miou"] is None or top is None or scores["miou"] > top:
                top, best, idle = scores["miou"], model, 0
            else:
                idle += settings.get("val_every", 1)
        row["seconds"] = round(time.monotonic() - started, 1)
        history.append(row)
        if tell:
            tell(row)
        if idle >= settings.get("patience", rounds + 1):
            break
    discard(judged)
    return Training(best, model, history)


def farthest_points(points: DataFrame, k: int, parts: int = 8) -> DataFrame:
    """``(bx, by, rank, pid)``: a spread subset of every block, by the point farthest from those taken.

    Blocks are cut into ``parts`` by ``parts`` cells, each with its box and its farthest point. Only cells
    whose box is nearer to the point just taken than that distance can change, so a round measures the points of
    these cells against those taken, and writes a row a cell; points are written once. Ties go to the smaller pid; a block
    ends early when all its points lie on taken ones. ``k`` is a small sample size.
    """
    block, key, at = ["bx", "by"], ["bx", "by", "ci", "cj"], ("x", "y", "z")
    span = points.groupBy(*block).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * parts)).otherwise(0).cast("int")
    placed = materialise(points.join(span, block).select(*block, part("x").alias("ci"), part("y").alias("cj"), "pid", *at), "fps-points")
    boxes = placed.groupBy(*key).agg(*[f(c).alias(f"{n}{c}") for c in at for n, f in (("lo", F.min), ("hi", F.max))])
    box = [f"{n}{c}" for c in at for n in ("lo", "hi")]
    far = F.max(F.struct("d", (-F.col("pid")).alias("o"), "pid", *at)).alias("far")
    first = materialise(placed.groupBy(*block).agg(F.min_by(F.struct("pid", *at), "pid").alias("p")).select(*block, "p.*"), "fps-taken")
    taken = first.select(*block, F.array(F.struct("pid", *at)).alias("taken"))
    every = placed.join(taken, block).withColumn("d", _to_taken(at))
    cells = materialise(every.groupBy(*key).agg(far).join(boxes, key), "fps-cells")
    for rank in range(2, k + 1):
        best = cells.groupBy(*block).agg(F.max("far").alias("b")).where("b.d > 0")
        new = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("pid", *at)])
        taken_before, taken = taken, materialise(taken.join(best, block, "left").select(*block, F.when(F.col("b").isNotNull(), F.array_append("taken", new)).otherwise(F.col("taken")).alias("taken")), "fps-taken")
        if rank == k:
            break
        last = taken.where(F.size("taken") == rank).withColumn("c", F.element_at("taken", -1))
        gap = lambda c: F.greatest(F.col(f"lo{c}") - F.col(f"c.{c}"), F.col(f"c.{c}") - F.col(f"hi{c}"), F.lit(0))
        reached = cells.join(last, block).where(sum(gap(c) * gap(c) for c in at) < F.col("far.d")).select(*key, "taken")
        again = placed.join(reached, key).withColumn("d", _to_taken(at)).groupBy(*key).agg(far.alias("near"))
        before, cells = cells, materialise(cells.join(again, key, "left").select(*key, F.coalesce("near", "far").alias("far"), *box), "fps-cells")
        discard(before)
        discard(taken_before)
    return taken.select(*block, F.posexplode("taken").alias("n", "p")).select(*block, (F.col("n") + 1).alias("rank"), "p.pid")


def _to_taken(at: Sequence[str]):
    """The squared distance of a point to the nearest of the array ``taken``."""
    return F.array_min(F.transform("taken", lambda t: sum((F.col(c) - t[c]) * (F.col(c) - t[c]) for c in at))).cast("double")
