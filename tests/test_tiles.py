"""Searches in tiles against brute force, with tiles so small that points ask beyond them."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.operators import clusters, labels, metrics, neighbours, register, tiles
from standscan.plans import queries as core

SF = "/root/testdata/sf0.001"


def integers(spark, xyz, first=0):
    return spark.createDataFrame([(first + i, *map(int, p)) for i, p in enumerate(xyz)], "pid long, x long, y long, z long")


def uneven(seed, n=500):
    """A dense layer, copies of one place, a sparse column and a far point."""
    rng = np.random.default_rng(seed)
    return np.vstack([rng.integers(0, 300, (n, 3)) // (1, 1, 10), np.full((40, 3), 77), rng.integers(0, 300, (30, 3)) * (1, 1, 20), [[9000, -9000, 0]]])


def brute(a, b, k, bound2=np.inf, closed=True):
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    keep = d <= bound2 if closed else d < bound2
    return {i: [(int(d[i, j]), int(j)) for j in sorted(np.flatnonzero(keep[i]), key=lambda j: (d[i, j], j))[:k]] for i in range(len(a))}


@pytest.mark.parametrize(("k", "bound", "closed"), [(6, None, True), (1, 45, False), (50, 60, True)])
def test_small_tiles_equal_brute_force(spark, k, bound, closed):
    a, b = uneven(1), uneven(2)
    rows = tiles.nearest_lists(integers(spark, a), integers(spark, b), k, bound=bound, closed=closed, keep=["x"], fields=["z"], per_tile=70).collect()
    want = brute(a, b, k, np.inf if bound is None else bound**2, closed)
    assert len(rows) == len(a)
    assert {r["pid"]: [(n["d2"], n["nid"]) for n in r["near"]] for r in rows} == want
    assert all(r["x"] == a[r["pid"]][0] and all(n["z"] == b[n["nid"]][2] for n in r["near"]) for r in rows)


def test_sums_in_reach_equal_brute_force(spark):
    a, b = uneven(3), uneven(4)
    near = ((a[:, None] - b[None]) ** 2).sum(-1) <= 50**2
    got = {r["pid"]: (r["n"], r["nids"]) for r in tiles.reach_sums(integers(spark, a), integers(spark, b, 1 << 40), 50, per_tile=70).collect()}
    assert got == {i: (int(near[i].sum()), int(((1 << 40) + np.flatnonzero(near[i])).sum())) for i in range(len(a)) if near[i].any()}


def test_points_without_a_place_or_a_target(spark):
    odd = spark.createDataFrame([(1, 1.0, float("nan"), 0.0), (2, None, 0.0, 0.0), (3, 1.0, 1.0, 1.0)], "pid long, x double, y double, z double")
    got = {r["pid"]: r["nid"] for r in neighbours.nearest_within(odd, odd, 5.0).collect()}
    assert got == {1: None, 2: None, 3: 3}
    assert neighbours.nearest_within(odd, odd.limit(0), 5.0).where("nid is null").count() == 3


@pytest.fixture()
def broadcasts(spark):
    """All tables count as small enough to broadcast, as the copies of 27 cells did by the size of the table copied."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_k_nearest_makes_no_pairs_of_cells(spark, broadcasts):
    points = integers(spark, uneven(5))
    assert "Broadcast" not in plan(neighbours.k_nearest(points, points, 10, 400))
    assert "Join" not in plan(neighbours.k_nearest(points, points, 10, 400))


def test_nearest_in_plan_makes_no_pairs(spark, broadcasts):
    points = integers(spark, uneven(7))
    made = plan(neighbours.nearest_within(points.where("pid % 2 = 0"), points.where("pid % 2 = 1"), 200, "xy"))
    assert "Join" not in made and "SortAggregate" not in made
    assert register.vertical_offset(points, points.withColumn("z", F.col("z") + 7), 2) == 7.0


def test_no_copies_of_cells_are_broadcast(spark, broadcasts):
    points = integers(spark, uneven(5))
    assert "Broadcast" not in plan(neighbours.pairs_within(points, points, 30).agg(F.count("*")))


QUERIES = [
    "icp_step_sums",
    "nearest_label_transfer",
    "radius_join",
    "nearest_join_bounded",
    "normal_features",
    "interpolate_three",
    "knn_smooth",
    "knn_density",
    "ball_query",
    "eigen_features",
    "dbscan_core_points",
    "knn_join_k10",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_queries_make_no_pairs_of_cells(spark, broadcasts, name):
    """No table of copies or pairs is joined, broadcast or windowed."""
    made = plan(core.queries()[name](spark, SF))
    assert not any(word in made for word in ("Broadcast", "Join", "Window", "Generate explode(array(")), made


def test_thinning_writes_no_pairs(spark, monkeypatch):
    """600 rows of a few places: the loop's result by rounds, from tables no longer than the input."""
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.integers(0, 300, (300, 2)), rng.integers(0, 30, (300, 2))])
    kept: list[int] = []
    for i in range(len(xy)):
        if all(((xy[i] - xy[j]) ** 2).sum() > 40**2 for j in kept):
            kept.append(i)
    written = []
    write = register.materialise
    monkeypatch.setattr(register, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(register, "discard", lambda df: None)
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "pid long, x long, y long")
    assert sorted(r["pid"] for r in register.thin(df, 40).collect()) == kept
    assert sorted(r["pid"] for r in register.thin(df, 40, rest=10).collect()) == kept
    assert all(t.count() <= len(xy) for t in written)


def test_dbscan_across_tiles_writes_no_pairs(spark, monkeypatch):
    """Clusters over many tiles, with border points between them; tables written are no longer than a few rows a point."""
    rng = np.random.default_rng(8)
    p = (np.vstack([rng.normal(c, 0.5, (150, 3)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, (150, 3)), np.full((100, 3), 9.0)])[rng.permutation(700)] * 100).astype(int)
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 45**2
    core = near.sum(1) >= 6
    root = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        stack = [i] if root[i] < 0 else []
        while stack:
            j = stack.pop()
            if root[j] < 0:
                root[j] = i
                stack += np.flatnonzero(near[j] & core).tolist()
    want = [root[near[i] & core].min() if not core[i] and (near[i] & core).any() else root[i] for i in range(len(p))]
    number = {r: n for n, r in enumerate(sorted({r for r in want if r >= 0}))} | {-1: -1}
    written = []
    write = clusters.materialise
    monkeypatch.setattr(clusters, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    got = clusters.dbscan(integers(spark, p), 45, 6, per_tile=60).collect()
    assert len(got) == len(p) and [dict(got)[i] for i in range(len(p))] == [number[r] for r in want]
    assert len(number) > 2 and sum(t.count() for t in written) < 6 * len(p) < near.sum()


@pytest.mark.parametrize("per_tile", [1 << 16, 60])
def test_matching_across_tiles_writes_no_pairs(spark, monkeypatch, per_tile):
    """Places with many copies and ties: the greedy result of all pairs, from tables no longer than the input."""
    rng = np.random.default_rng(9)
    a, b = (np.vstack([rng.integers(0, 200, (260, 2)), rng.integers(0, 20, (60, 2)) * 10, np.full((30, 2), v)]) for v in (50, 53))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    want, rs, qs = {}, set(), set()
    for dist, i, j in sorted((d[i, j], i, j) for i, j in zip(*np.nonzero(d <= 25), strict=True)):
        if i not in rs and j not in qs:
            rs.add(i), qs.add(j)
            want[int(i)] = (int(j), float(dist))
    make = lambda p: spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(p)], "id long, x long, y long")
    written = []
    write = metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    got = {r["rid"]: (r["qid"], r["distance"]) for r in metrics.match_centres(make(a), make(b), 25, per_tile=per_tile).collect()}
    assert got == want
    assert all(t.count() <= len(a) for t in written) and (per_tile > 60 or len(written) > 1)


def test_centres_are_matched_without_a_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    xy = rng.uniform(0, 100, (150, 2))
    make = lambda p: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid long, x double, y double")
    written = []
    write = register.materialise
    monkeypatch.setattr(register, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    flat, hits = register.match_centres_2d(make(xy), make(np.column_stack([7 - xy[:, 1], xy[:, 0] + 13])), draws=100)
    assert hits == 150 and np.allclose(flat, [[0, -1, 7], [1, 0, 13], [0, 0, 1]], atol=1e-6)
    assert all(t.count() <= 150 for t in written)


def test_reference_labels_travel_with_the_neighbours(spark, broadcasts, monkeypatch):
    cloud = integers(spark, uneven(11)).withColumn("label", (F.col("pid") % 3).cast("int"))
    plans = []
    write = labels.materialise
    monkeypatch.setattr(labels, "materialise", lambda df, name: plans.append(plan(df)) or write(df, name))
    report = labels.compare_with_reference(cloud, cloud, {0: 0, 1: 1, 2: 2}, 3, 20)
    assert report["matched_fraction"] == 1.0 and report["ignored_fraction"] == 0.0
    assert plans and not any("Join" in p for p in plans)


def test_instances_write_no_pairs(spark, monkeypatch):
    """300 copies of one place and a few points elsewhere: 90,000 pairs in reach, tables of a few rows a point."""
    p = np.vstack([np.full((300, 3), 7), np.arange(30)[:, None] * 500 * np.ones((1, 3), int)])
    points = integers(spark, p).withColumns({"pred": F.lit(2), "hag": F.col("z")})
    written = []
    write = clusters.materialise
    monkeypatch.setattr(clusters, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    found = {r["pid"]: r["instance"] for r in clusters.extract_instances(points, 2, 150, 6)[0].collect()}
    assert len(found) == len(p) and sorted(i for i in found if found[i] == 0) == list(range(301)) and {found[i] for i in range(301, 330)} == {-1}
    assert sum(t.count() for t in written) < 6 * len(p)
