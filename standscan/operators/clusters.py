"""Density clustering, cluster statistics and rule-based stump detection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import cell
from standscan.operators.components import connected_components
from standscan.operators.order import percentiles, running_total
from standscan.operators.tiles import count_rows, nearest_rows, places, reach_sums, square, united, within_tiles
from standscan.session import materialise


def core_points(points: DataFrame, eps, min_samples: int, dims: str = "xyz") -> DataFrame:
    """``(pid, n)`` of the points with at least ``min_samples`` points within ``eps``, themselves included."""
    return reach_sums(points, points, eps, dims).where(F.col("n") >= min_samples).select("pid", "n")


def dbscan(points: DataFrame, eps, min_samples: int, dims: str = "xyz", per_tile: int = 1 << 16) -> DataFrame:
    """``(pid, cluster)`` of every point; -1 is noise, clusters are numbered by their smallest core pid.

    Clusters are the components of the core-core links. A border point joins the
    cluster with the smallest root among its core neighbours. All points of a cell, so narrow that
    they are in reach of each other, lie in one tile; a tile finds the clusters in it and its halo, and only the
    cells near its edge are linked to those of other tiles. Pairs of points are not written.
    """
    width = eps / len(dims) ** 0.5 * (1 - 1e-9)
    axes = [f"ss_{c}" for c in dims]
    celled = points.select("pid", *dims, *[cell(F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c)), width).alias(a) for c, a in zip(dims, axes, strict=True)])
    reach = math.isqrt(len(dims)) + 1
    search = partial(_tile_clusters, dims=dims, axes=axes, eps=eps, min_samples=min_samples, reach=reach)
    rows = materialise(within_tiles(celled, axes, search, "pid long, root long, link long", 2 * reach, per_tile), "dbscan-tiles")
    comps = connected_components(rows.where("pid is null"), "root", "link")
    roots = rows.where("pid is not null and root is not null").select("root").distinct()
    named = roots.join(comps, F.col("root") == F.col("node"), "left").select("root", F.coalesce("component", "root").alias("component"))
    named = materialise(named, "dbscan-roots")
    order = running_total(named.select("component").distinct(), ["component"], F.lit(1).cast("bigint"), "number")
    numbers = materialise(named.join(order, "component").select("root", (F.col("number") - 1).alias("number")), "dbscan-numbers")
    found = rows.where("pid is not null").join(numbers, "root", "left").select("pid", "link", F.coalesce("number", F.lit(-1)).cast("bigint").alias("cluster"))
    several = found.where("link is not null").groupBy("pid").agg(F.min("cluster").alias("cluster"))
    nowhere = F.lit(False)
    for a in axes:
        nowhere = nowhere | F.col(a).isNull()
    return found.where("link is null").select("pid", "cluster").unionByName(several).unionByName(celled.where(nowhere).select("pid", F.lit(-1).cast("bigint").alias("cluster")))


def _tile_clusters(box, table: pa.Table, dims: str, axes: Sequence[str], eps, min_samples: int, reach: int) -> pa.Table:
    """Rows ``(pid, root)`` of the tile's own points, and links between roots and the cells near its edge, with no pid.

    A root is the smallest core pid of a cluster as far as the tile sees it. A border point of several
    has a row each, marked by ``link``; a noise point has no root.
    """
    pid, at, cells = table.column("pid").to_numpy(), places(table, dims), places(table, axes)
    order = np.lexsort((pid, *cells.T[::-1]))
    pid, at, cells = pid[order], at[order], cells[order]
    fresh = np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]
    of = np.cumsum(fresh) - 1
    names, sizes = cells[fresh], np.bincount(of)
    outside = np.maximum(box[0] + 1 - names, names - box[1]).max(axis=1)  # 0 or less within the tile
    used = (outside <= reach)[of]
    core = used & (sizes >= min_samples)[of]
    rest = np.flatnonzero(used & ~core)
    core[rest] = count_rows(at[rest], at, np.ones((len(at), 1)), float(eps))[:, 0] >= min_samples
    members = np.flatnonzero(core)
    hubs, first, count = np.unique(of[members], return_index=True, return_counts=True)
    spot, mine = names[hubs], outside[hubs] <= 0
    low = names.min(axis=0) - reach
    span = names.max(axis=0) + reach + 1 - low
    scale = np.array([math.prod(int(s) for s in span[d + 1 :]) for d in range(len(dims))])
    key = ((spot - low) * scale).sum(axis=1)
    root, limit = np.arange(len(hubs)), eps * eps
    steps = sorted((s for s in product(range(-reach, reach + 1), repeat=len(dims)) if s > (0,) * len(dims)), key=lambda s: sum(x * x for x in s))

    def touching(a, b, most):
        """Whether cells have a core pair in reach, by the first ``most`` of each."""
        out, na, nb = np.zeros(len(a), bool), np.minimum(count[a], most), np.minimum(count[b], most)
        total, start = np.cumsum(na * nb), 0
        while start < len(a):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 20), "right")))
            n = na[start:end] * nb[start:end]
            pair = np.repeat(np.arange(start, end), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left, right = members[first[a[pair]] + k // nb[pair]], members[first[b[pair]] + k % nb[pair]]
            out |= np.bincount(pair[square(at[left], at[right]) <= limit], minlength=len(a)) > 0
            start = end
        return out

    for step in steps if len(hubs) else ():
        near = np.minimum(np.searchsorted(key, key + (np.array(step) * scale).sum()), len(key) - 1)
        a = np.flatnonzero((spot[near] == spot + np.array(step)).all(axis=1) & (mine | mine[near]) & (root != root[near]))
        for most in (16, 1 << 40):
            a = a[root[a] != root[near[a]]]
            joined = a[touching(a, near[a], most)]
            root = united(len(root), joined, near[joined], root)
    least = np.full(len(hubs), np.iinfo(np.int64).max)
    smallest = pid[members[first]] if len(hubs) else least
    np.minimum.at(least, root, smallest)
    rooted = np.zeros(len(sizes), np.int64)
    rooted[hubs] = least[root]
    inside = (outside <= 0)[of]
    own = np.flatnonzero(inside & core)
    loose = np.flatnonzero(inside & ~core)
    q, hit, _ = nearest_rows(at[loose], at[members], np.arange(len(members)), min_samples, limit)
    border = np.unique(np.column_stack([loose[q], rooted[of[members[hit]]]]), axis=0) if len(q) else np.zeros((0, 2), np.int64)
    n = np.bincount(border[:, 0], minlength=len(pid))
    noise = loose[n[loose] == 0]
    edge = hubs[np.maximum(names[hubs] - (box[1] - reach), box[0] + 1 + reach - names[hubs]).max(axis=1) > 0]
    cell_least = np.zeros(len(sizes), np.int64)
    cell_least[hubs] = smallest
    edge = edge[rooted[edge] != cell_least[edge]]
    ids = pa.array(np.r_[pid[own], pid[border[:, 0]], pid[noise], np.zeros(len(edge), np.int64)], mask=np.r_[np.zeros(len(own) + len(border) + len(noise), bool), np.ones(len(edge), bool)])
    tops = pa.array(np.r_[rooted[of[own]], border[:, 1], np.zeros(len(noise), np.int64), rooted[edge]], mask=np.r_[np.zeros(len(own) + len(border), bool), np.ones(len(noise), bool), np.zeros(len(edge), bool)])
    links = pa.array(np.r_[np.zeros(len(own), np.int64), np.ones(len(border), np.int64), np.zeros(len(noise), np.int64), cell_least[edge]], mask=np.r_[np.ones(len(own), bool), n[border[:, 0]] < 2, np.ones(len(noise), bool), np.zeros(len(edge), bool)])
    return pa.table({"pid": ids, "root": tops, "link": links})


def renumber(df: DataFrame, root: str, out: str) -> DataFrame:
    """Dense numbers from 0 in the order of ``root``; null becomes -1."""
    roots = df.where(F.col(root).isNotNull()).select(root).distinct()
    order = running_total(roots, [root], F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)
    return df.join(order, root, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("bigint")).drop(root)


def cluster_stats(points: DataFrame, by: str = "cluster", scattering: str | None = None, metre: float = 1.0) -> DataFrame:
    """Count, centre, terrain, height, diameter, roundness, scattering and slenderness per cluster.

    ``metre`` is the length of a metre in the cloud's units; it scales the guards of the
    covariance and the slenderness. The percentiles hold no cluster's values in one task.
    """
    p = points.where(F.col(by) >= 0)
    centres = p.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    p = p.join(materialise(centres, "cluster-centres"), by)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    wanted = {"ground_z": (F.col("z") - F.col("hag"), 0.5), "height": (F.col("hag"), 0.98), "ss_reach": (F.sqrt(dx * dx + dy * dy), 0.9)}
    middle = percentiles(p, [by], wanted).withColumn("diameter", 2 * F.col("ss_reach"))
    s = p.groupBy(by).agg(
        F.count("*").alias("n_points"),
        F.first("cx").alias("x"),
        F.first("cy").alias("y"),
        F.var_samp("x").alias("vx"),
        F.var_samp("y").alias("vy"),
        F.covar_samp("x", "y").alias("vxy"),
        (F.avg(scattering) if scattering else F.lit(None).cast("double")).alias("scattering"),
    ).join(middle, by, "left")
    tiny = 1e-9 * metre * metre
    a, d, b = F.coalesce("vx", F.lit(0.0)) + tiny, F.coalesce("vy", F.lit(0.0)) + tiny, F.coalesce("vxy", F.lit(0.0))
    gap = F.sqrt((a - d) * (a - d) + 4 * b * b)
    return s.select(
        F.col(by).alias("id"),
        "n_points",
        "x",
        "y",
        "ground_z",
        "height",
        "diameter",
        F.sqrt(F.greatest(F.lit(0.0), (a + d - gap) / (a + d + gap))).alias("roundness"),
        "scattering",
        (F.col("height") / F.greatest(F.col("diameter"), F.lit(1e-3 * metre))).alias("slenderness"),
    )


def accept(stats: DataFrame, rules: Mapping) -> DataFrame:
    """Append ``accepted`` and the dense ``stump_id`` of the accepted clusters (-1 otherwise)."""
    ok = (
        (F.col("n_points") >= rules["min_points"])
        & F.col("height").between(*rules["height"])
        & F.col("diameter").between(*rules["diameter"])
        & (F.col("roundness") >= rules["min_roundness"])
        & (F.col("slenderness") <= rules["max_slenderness"])
        & F.coalesce(F.col("scattering") <= rules["max_scattering"], F.lit(True))
    )
    judged = stats.withColumn("accepted", ok)
    return renumber(judged.withColumn("ss_root", F.when(F.col("accepted"), F.col("id"))), "ss_root", "stump_id")


def stump_candidates(points: DataFrame, rules: Mapping) -> DataFrame:
    return points.where((F.col("hag") >= rules["min_hag"]) & (F.col("hag") <= rules["max_hag"]) & (F.col("column_stack_hag") <= rules["max_stack_hag"]))


def detect_stumps(points: DataFrame, rules: Mapping, scattering: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pid, instance)`` of every point, and the table of all candidate clusters.

    With fewer candidates than ``min_points`` the table is empty, in its full schema.
    """
    cand = materialise(stump_candidates(points, rules), "stump-candidates")
    few = cand.count() < rules["min_points"]
    labelled = cand.join(dbscan(cand.limit(0) if few else cand, rules["eps"], rules["min_samples"]), "pid")
    labelled = materialise(labelled, "stump-clusters")
    stats = materialise(accept(cluster_stats(labelled, scattering=scattering if scattering in points.columns else None), rules), "stump-stats")
    named = labelled.select("pid", F.col("cluster").alias("id")).join(stats.where("accepted").select("id", "stump_id"), "id").select("pid", F.col("stump_id").alias("instance"))
    instance = points.select("pid").join(named, "pid", "left").select("pid", F.coalesce("instance", F.lit(-1)).cast("bigint").alias("instance"))
    return instance, stats


def extract_instances(points: DataFrame, class_id: int, eps, min_points: int, pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Cluster the points predicted as ``class_id``; clusters below ``min_points`` are dropped."""
    mine = points.where(F.col(pred) == class_id)
    clustered = dbscan(mine, eps, min(10, min_points))
    sizes = clustered.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("cluster", F.col("cluster").alias("root"))
    kept = renumber(clustered.join(sizes, "cluster").select("pid", "root"), "root", "instance")
    instance = materialise(points.select("pid").join(kept, "pid", "left").select("pid", F.coalesce("instance", F.lit(-1)).alias("instance")), "instances")
    return instance, cluster_stats(points.join(instance, "pid"), "instance")
