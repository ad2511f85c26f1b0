"""Confusion matrices, segmentation metrics, class weights and one-to-one matching."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import cell
from standscan.operators.points import IGNORE
from standscan.operators.tiles import nearest_rows, places, square, within_tiles
from standscan.session import materialise


def confusion(scored: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """``(target, pred, n)`` without ignored targets."""
    return scored.where(F.col(target) != IGNORE).groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Per class: support, iou, precision, recall and f1, rounded to 4; null where undefined."""
    cells = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("target").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    s = cells.groupBy(F.col("c").alias("class")).agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b)
    s = s.withColumns(
        {
            "iou": ratio(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp")),
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
        }
    )
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return s.select("class", "support", *[F.round(c, 4).alias(c) for c in ("iou", "precision", "recall")], F.round(f1, 4).alias("f1"))


def summarise(counts: DataFrame, n_classes: int) -> dict:
    """The matrix and its summary on the driver; it has one row per pair of classes.

    Points without a class in range, in either column, are not counted.
    """
    matrix = [[0] * n_classes for _ in range(n_classes)]
    for r in counts.collect():
        if r["pred"] is not None and 0 <= r["pred"] < n_classes and 0 <= r["target"] < n_classes:
            matrix[r["target"]][r["pred"]] += r["n"]
    per, total = [], sum(map(sum, matrix))
    for c in range(n_classes):
        tp, support, predicted = matrix[c][c], sum(matrix[c]), sum(row[c] for row in matrix)
        union = support + predicted - tp
        precision, recall = tp / predicted if predicted else None, tp / support if support else None
        f1 = 2 * precision * recall / (precision + recall) if precision is not None and recall is not None and precision + recall > 0 else None
        per.append({"iou": tp / union if union else None, "precision": precision, "recall": recall, "f1": f1, "support": support})
    seen = [p for p in per if p["support"]]
    mean = lambda k: round(sum(p[k] for p in seen) / len(seen), 4) if seen else None
    rounded = [{k: round(v, 4) if isinstance(v, float) else v for k, v in p.items()} for p in per]
    return {
        "overall_accuracy": round(sum(matrix[c][c] for c in range(n_classes)) / total, 4) if total else None,
        "mean_accuracy": mean("recall"),
        "miou": mean("iou"),
        "per_class": rounded,
        "confusion_matrix": matrix,
    }


def as_text(report: dict, classes: list[str]) -> str:
    """A summary as lines of text, a class each below the means."""
    shown = lambda v: "-" if v is None else f"{v:.4f}"
    columns = ("iou", "precision", "recall", "f1")
    lines = [" ".join(f"{k} {shown(report[k])}" for k in ("overall_accuracy", "mean_accuracy", "miou")), " ".join(["class".ljust(14), *[c.rjust(9) for c in columns], "support".rjust(11)])]
    for name, row in zip(classes, report["per_class"], strict=True):
        lines.append(" ".join([name.ljust(14), *[shown(row[c]).rjust(9) for c in columns], str(row["support"]).rjust(11)]))
    return "\n".join(lines)


def class_weights(labels: DataFrame, label: str = "label", mode: str = "log") -> DataFrame:
    """``(label, n, weight)`` of the classes present, divided by their mean; modes none, inverse_sqrt and log."""
    counts = labels.where(F.col(label) >= 0).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    counts = materialise(counts, "class-counts")  # a row for each class
    share = F.col("n") / F.lit(float(counts.agg(F.sum("n").alias("n")).first()["n"] or 1))
    raw = {"none": F.lit(1.0), "inverse_sqrt": 1.0 / F.sqrt(F.greatest(share, F.lit(1e-6)))}.get(mode, 1.0 / F.log(1.02 + share))
    mean = counts.agg(F.avg(raw).alias("m")).first()["m"] or 1.0
    return counts.select("label", "n", (raw / F.lit(mean)).alias("weight"))


def match_centres(refs: DataFrame, preds: DataFrame, max_distance: float, per_tile: int = 1 << 16) -> DataFrame:
    """``(rid, qid, distance)``: greedy one-to-one matching of ``(id, x, y)`` by distance, then rid and qid.

    Tiles match the objects in them and their halo in that order and keep what no object beyond the halo
    can change. The references left open, few and near edges, meet the free predictions in reach in new tiles. The
    nearest open pair is always settled, so rounds end; what fits one tile is settled at once. No pairs are written.
    """
    kinds = {n: dict(d.dtypes)["id"] for n, d in (("rid", refs), ("qid", preds))}
    refs, preds = (d.select(F.col("id").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")) for d in (refs, preds))
    spark, schema = refs.sparkSession, f"rid {kinds['rid']}, qid {kinds['qid']}, distance double"
    search = partial(_match_tile, max_distance=float(max_distance), halo=2.0 * max_distance)
    size = max_distance if max_distance > 0 else 1.0
    at = {c: cell(c, size) for c in "xy"}
    around = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    paths: list[str] = []
    while True:
        both = refs.withColumn("side", F.lit(0)).unionByName(preds.withColumn("side", F.lit(1)))
        done = materialise(within_tiles(both, "xy", search, schema, 2.0 * max_distance, per_tile), "match-won")
        paths.append(done._standscan_path)
        left = done.where("qid is null").select(F.col("rid").alias("pid"))
        if left.isEmpty():
            break
        refs = materialise(refs.join(left, "pid", "left_semi"), "match-refs")
        near = refs.select(F.explode(around).alias("s"), at["x"].alias("i"), at["y"].alias("j")).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct()
        free = preds.join(done.where("qid is not null").select(F.col("qid").alias("pid")), "pid", "left_anti").withColumns({"i": at["x"], "j": at["y"]})
        preds = materialise(free.join(near, ["i", "j"], "left_semi").select("pid", "x", "y"), "match-preds")
    return spark.read.schema(schema).parquet(*paths).where("qid is not null")


def _grouped(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by place and value, the first of each place with the end, and the places."""
    order = np.lexsort((ids, *at.T[::-1]))
    ids, at = ids[order], at[order]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(at) else np.zeros(0, np.int64)
    return ids, np.r_[first, len(ids)], at[first]


def _match_tile(box, table: pa.Table, max_distance: float, halo: float, listed: int = 16) -> pa.Table:
    """The settled matches of the tile's own references, and those of its references still open, without a qid.

    Objects of one place queue by id. A pair is open if it is longer than the way from either object to the end of
    what the tile sees, or if its prediction may have been taken by an open reference; the reference is then open,
    and so is each prediction from its distance to that reference on.
    """
    ids, at, side = table.column("pid").to_numpy(), places(table, "xy").astype(np.float64), table.column("side").to_numpy()
    (rid, r_first, r_at), (qid, q_first, q_at) = (_grouped(ids[side == s], at[side == s]) for s in (0, 1))
    margins = [np.minimum(p - (box[0] - halo), box[1] + halo - p).min(axis=1) * (1 - 1e-12) if len(p) else np.zeros(0) for p in (r_at, q_at)]
    r_seen, q_seen = margins[0].tolist(), margins[1]
    alive, open_from = np.ones(len(q_at), bool), np.full(len(q_at), np.inf)
    q_next, q_end, r_end = q_first[:-1].tolist(), q_first[1:].tolist(), r_first[1:].tolist()
    r_next = r_first[:-1].tolist()
    near: list = [([], [], 0, False)] * len(r_at)  # predictions' places, distances, the next of them, whether that is all
    query, hit, d2 = nearest_rows(r_at, q_at, np.arange(len(q_at)), listed, max_distance * max_distance * (1 + 1e-9))
    ends = np.searchsorted(query, np.arange(len(r_at) + 1))
    gaps = np.sqrt(d2)
    for p in range(len(r_at)):
        h, g = hit[ends[p] : ends[p + 1]], gaps[ends[p] : ends[p + 1]]
        if full := len(h) < listed:
            keep = g <= max_distance
        else:  # others may be as far as the last
            keep = (g < g[-1]) & (g <= max_distance)
        near[p] = (h[keep].tolist(), g[keep].tolist(), 0, full or bool(g[-1] > max_distance))

    def lookup(p):
        """The free places within the largest distance of place ``p``, and their distances."""
        free = np.flatnonzero(alive)
        g = np.sqrt(square(r_at[p], q_at[free]))
        inside = g <= max_distance
        return free[inside], g[inside]

    def best(p):
        """The nearest free prediction of a place of references, with the smallest id of all as near."""
        while True:
            hits, far, k, whole = near[p]
            while k < len(hits) and not alive[hits[k]]:
                k += 1
            if k < len(hits):
                near[p] = (hits, far, k, whole)
                found, d = None, far[k]
                while k < len(hits) and far[k] == d:
                    if alive[hits[k]] and (found is None or qid[q_next[hits[k]]] < found[0]):
                        found = (qid[q_next[hits[k]]], hits[k])
                    k += 1
                return d, *found
            if whole:
                return None
            free, g = lookup(p)
            if whole := len(g) <= listed:
                keep = np.arange(len(g))
            else:
                keep = np.flatnonzero(g <= np.partition(g, listed)[listed])
            keep = keep[np.argsort(g[keep], kind="stable")]
            near[p] = (free[keep].tolist(), g[keep].tolist(), 0, whole)

    queue, won, opened = [], [], []

    def ask(p):
        if (b := best(p)) is not None:
            heapq.heappush(queue, (b[0], rid[r_next[p]], b[1], p, b[2]))

    for p in range(len(r_at)):
        ask(p)
    while queue:
        d, r, q, p, o = heapq.heappop(queue)
        if not alive[o] or qid[q_next[o]] != q:
            ask(p)
        elif d <= r_seen[p] and d <= q_seen[o] and d < open_from[o]:
            won.append((p, r, q, d))
            q_next[o] += 1
            alive[o] = q_next[o] < q_end[o]
            r_next[p] += 1
            if r_next[p] < r_end[p]:
                ask(p)
        else:
            free, g = lookup(p)
            free, g = free[g >= d], g[g >= d]
            open_from[free] = np.minimum(open_from[free], g)
            opened += [(p, x, None, None) for x in rid[r_next[p] : r_end[p]]]
    own = ((r_at > box[0]) & (r_at <= box[1])).all(axis=1)
    rows = [x for x in won + opened if own[x[0]]]
    kind = table.schema.field("pid").type
    return pa.table({n: pa.array([x[i] for x in rows], t) for i, n, t in ((1, "rid", kind), (2, "qid", kind), (3, "distance", pa.float64()))})


def detection_scores(n_refs: int, n_preds: int, n_matched: int) -> dict:
    """Precision, recall and F1 of matched objects, rounded to 4; zeros if a side is empty."""
    p, r = (n_matched / n_preds if n_preds else 0.0), (n_matched / n_refs if n_refs else 0.0)
    return {"n_ref": n_refs, "n_pred": n_preds, "matched": n_matched, "precision": round(p, 4), "recall": round(r, 4), "f1": round(2 * p * r / (p + r), 4) if p + r else 0.0}


def instance_centres(points: DataFrame, instance: str = "instance") -> DataFrame:
    return points.where(F.col(instance) >= 0).groupBy(F.col(instance).alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
