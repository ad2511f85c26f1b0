from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from standscan.functions.cloud import symmetric_eigenvalues
from standscan.operators import clusters, components, labels, metrics, neighbours, order, points, raster, register, shape, split
from standscan.plans import cli, config


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (7, 9), (None, 4), (9, 8), (3, 2)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.connected_components(chain).select("component").distinct().count() == 1


def test_voxel_and_finite(spark):
    rng = np.random.default_rng(0)
    df = cloud(spark, rng.uniform(0, 1, (2000, 3)))
    kept = points.voxel_downsample(df, 0.25)
    anchor = points.origin(df)
    keys = {tuple(int((r[c] - o) // 0.25) for c, o in zip("xyz", anchor, strict=True)) for r in kept.collect()}
    assert kept.count() == len(keys) <= 64 + 61
    assert points.voxel_downsample(df, 0).count() == 2000
    odd = spark.createDataFrame([(1, 1.0, float("nan"), 0.0), (2, float("inf"), 0.0, 0.0), (3, None, 0.0, 0.0), (4, 1.0, 1.0, 1.0)], "pid long, x double, y double, z double")
    assert [r["pid"] for r in points.finite(odd).collect()] == [4]
    assert points.voxel_downsample(odd.limit(0), 0.5).count() == 0


def test_k_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(30, 5, (10, 3))])
    df = cloud(spark, p)
    got = {}
    for r in neighbours.k_nearest(df, df, 6, 0.5).collect():
        got.setdefault(r["pid"], []).append((r["rank"], r["nid"]))
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for i in range(len(p)):
        want = sorted(range(len(p)), key=lambda j: (d[i, j], j))[:6]
        assert [n for _, n in sorted(got[i])] == want
    few = cloud(spark, p[:3])
    assert neighbours.k_nearest(few, few, 10, 0.5).count() == 9


def test_radius_and_bound(spark):
    a, b = cloud(spark, [(0, 0, 0), (5, 0, 0)]), cloud(spark, [(1, 0, 0), (0, 1, 0)])
    assert [r["pid"] for r in neighbours.within_radius(a, b, 1.0).collect()] == [0]
    near = {r["pid"]: r["nid"] for r in neighbours.nearest_within(a, b, 1.0).collect()}
    assert near == {0: None, 1: None}  # the bound itself is not inside
    assert {r["pid"]: r["nid"] for r in neighbours.nearest_within(a, b, 1.1).collect()} == {0: 0, 1: None}


def test_shape_of_plane_and_line(spark):
    rng = np.random.default_rng(2)
    plane = np.column_stack([rng.uniform(0, 2, (500, 2)), np.zeros(500)])
    line = np.column_stack([rng.uniform(0, 20, 300), rng.normal(0, 1e-3, (300, 2))])
    made = {}
    for name, p in (("plane", plane), ("line", line)):
        df = cloud(spark, p)
        made[name] = shape.shape_features(df, [12], 0.3).agg(*[F.median(f"{f}_k12").alias(f) for f in ("linearity", "planarity", "scattering", "normal_z")]).first()
    assert made["plane"]["scattering"] < 0.01 and made["plane"]["normal_z"] > 0.99
    assert made["line"]["linearity"] > 0.8 and made["plane"]["planarity"] > made["line"]["planarity"]


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(50):
        m = rng.normal(0, 1, (3, 3))
        m = m @ m.T
        rows.append([float(m[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = df.select("*", *symmetric_eigenvalues(*[F.col(c) for c in "abcdef"])).toPandas().to_numpy()
    for r in got:
        want = np.linalg.eigvalsh([[r[0], r[1], r[2]], [r[1], r[3], r[4]], [r[2], r[4], r[5]]])[::-1]
        assert np.allclose(r[6:], want, atol=1e-9)


def test_dbscan_matches_sequential(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(c, 0.2, (25, 3)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, (25, 3))])
    got = {r["pid"]: r["cluster"] for r in clusters.dbscan(cloud(spark, p), 0.35, 5).collect()}
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 0.35**2
    core = near.sum(1) >= 5
    want, n = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and want[i] < 0:
            stack = [i]
            want[i] = n
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(near[j]):
                    if want[k] < 0:
                        want[k] = n
                        if core[k]:
                            stack.append(k)
            n += 1
    assert [got[i] for i in range(len(p))] == want.tolist()


def test_morphology_matches_reflected_filter(spark):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 100, (7, 9)).astype(float)
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(7) for j in range(9)], "i long, j long, z double")

    def slide(a, fn, h):
        q = np.pad(a, h, "symmetric")
        return np.array([[fn(q[i : i + 2 * h + 1, j : j + 2 * h + 1]) for j in range(a.shape[1])] for i in range(a.shape[0])])

    got = np.zeros_like(z)
    for r in raster.opening(df, 5).collect():
        got[r["i"], r["j"]] = r["z"]
    assert np.array_equal(got, slide(slide(z, np.min, 2), np.max, 2))
    blurred = raster.gaussian(df, 1.0).toPandas()
    assert abs(blurred["z"].mean() - z.mean()) < 3


def test_fill_nearest(spark):
    rows = [(i, j, 1.0 if (i, j) == (0, 0) else 5.0 if (i, j) == (9, 9) else None) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(rows, "i long, j long, z double")
    got = {(r["i"], r["j"]): r["z"] for r in raster.fill_nearest(df).collect()}
    assert len(got) == 100 and got[1, 2] == 1.0 and got[8, 7] == 5.0 and got[4, 5] == 1.0
    with pytest.raises(ValueError):
        raster.fill_nearest(df.withColumn("z", F.lit(None).cast("double")))


def test_terrain_removes_objects(spark):
    rng = np.random.default_rng(6)
    ground = np.column_stack([rng.uniform(0, 10, (8000, 2)), np.zeros(8000)])
    ground[:, 2] = 0.05 * ground[:, 0] + rng.normal(0, 0.01, 8000)
    box = np.column_stack([rng.uniform(4, 4.6, (300, 2)), np.full(300, 0.2 + 0.5)])
    df = raster.fit_terrain(cloud(spark, np.vstack([ground, box]))).add_height(cloud(spark, np.vstack([ground, box])))
    out = df.select("pid", "hag").toPandas().set_index("pid")["hag"].sort_index()
    assert abs(out[:7999].median()) < 0.05 and out[8000:].median() > 0.3


def test_confusion_and_weights(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 2, 2], [0, 1, 1, 2, -1], strict=True)), "pred int, target int")
    report = metrics.summarise(metrics.confusion(df), 3)
    assert report["overall_accuracy"] == 0.75
    assert [c["iou"] for c in report["per_class"]] == [0.5, 0.5, 1.0]
    weights = {r["label"]: r["weight"] for r in metrics.class_weights(df.withColumnRenamed("target", "label"), mode="none").collect()}
    assert weights == {0: 1.0, 1: 1.0, 2: 1.0}


def test_matching_equals_greedy(spark):
    rng = np.random.default_rng(7)
    a, b = rng.uniform(0, 5, (30, 2)), rng.uniform(0, 5, (35, 2))
    make = lambda p: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    got = {(r["rid"], r["qid"]) for r in metrics.match_centres(make(a), make(b), 0.75).collect()}
    used, want = (set(), set()), set()
    for d, i, j in sorted((np.hypot(*(a[i] - b[j])), i, j) for i, j in itertools.product(range(30), range(35))):
        if d <= 0.75 and i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.add((i, j))
    assert got == want
    assert metrics.detection_scores(0, 3, 0)["f1"] == 0.0


def test_split_keeps_tiles_whole(spark):
    rng = np.random.default_rng(8)
    df = cloud(spark, rng.uniform(0, 1, (5000, 3)) * (100, 100, 1))
    done = split.spatial_split(df, 10, (70, 15, 15)).toPandas()
    tiles = done.assign(i=((done.x - done.x.min()) // 10), j=((done.y - done.y.min()) // 10)).groupby(["i", "j"])["split"].nunique()
    assert tiles.max() == 1 and set(done["split"]) == {0, 1, 2}
    assert abs((done["split"] == 0).mean() - 0.7) < 0.15


def test_blocks_cover_all_points(spark):
    rng = np.random.default_rng(9)
    df = cloud(spark, rng.uniform(0, 1, (800, 3)) * (20, 20, 2))
    blocks = split.eval_blocks(df, 6, 3, 1e-6)
    assert blocks.select("pid").distinct().count() == 800
    sizes = split.chunks(blocks, 64).groupBy("bx", "by", "chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 64


def test_icp_recovers_a_shift(spark):
    rng = np.random.default_rng(10)
    p = rng.uniform(0, 4, (300, 3))
    c, s = np.cos(0.02), np.sin(0.02)
    moved = p @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + (0.03, -0.02, 0.05)
    matrix, share, rms = register.icp(cloud(spark, p), cloud(spark, moved), np.eye(4), 0.3, 6)
    assert share > 0.95 and rms < 0.05
    assert np.abs(p @ matrix[:3, :3].T + matrix[:3, 3] - moved).max() < 0.05


def test_ransac_recovers_a_turn(spark):
    rng = np.random.default_rng(11)
    src = rng.uniform(-20, 20, (15, 2))
    a = np.deg2rad(-79)
    dst = src @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]).T + (3, 4)
    flat, hits = register.ransac_2d(spark, src, dst, iterations=30)
    assert hits == 15 and np.abs(src @ flat[:2, :2].T + flat[:2, 2] - dst).max() < 0.1


def _places(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid long, x double, y double")


def test_length_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    xy = rng.uniform(0, 30, (60, 2))
    gap = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    want = {(int(p), int(q)) for p, q in np.argwhere((gap >= 8.7) & (gap <= 9.3)) if p != q}
    found = register.length_pairs(_places(spark, xy), 8.7, 9.3)
    assert {(r["pid"], r["nid"]) for r in found.collect()} == want
    drawn = [(r["pid"], r["nid"]) for r in register.draw_pairs(found, 20).collect()]
    assert len(set(drawn)) == 20 and set(drawn) <= want and all(p < q for p, q in drawn)


def test_motion_hits_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    src, dst = rng.uniform(0, 20, (40, 2)), rng.uniform(0, 20, (50, 2))
    motions = [(np.cos(a), np.sin(a), tx, 20.0 - tx) for a, tx in rng.uniform(0, 6, (5, 2))] + [(1.0, 0.0, 500.0, 0.0)]
    got = {r["h"]: r["hits"] for r in register.motion_hits(_places(spark, src), _places(spark, dst), motions, 0.8).collect()}
    for h, (c, s, tx, ty) in enumerate(motions):
        moved = src @ np.array([[c, -s], [s, c]]).T + (tx, ty)
        assert got.get(h, 0) == int((np.hypot(*(moved[:, None] - dst[None]).transpose(2, 0, 1)).min(axis=1) < 0.8).sum())


def test_match_equals_the_best_of_all_pairs(spark):
    """Half of the source has no target, half of the targets no source; centres are off by some centimetres, far from the origin."""
    rng = np.random.default_rng(14)
    src = rng.uniform(0, 60, (40, 2)) + (5e5, 4e6)
    a = np.deg2rad(133)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    mean = src.mean(axis=0)
    dst = np.concatenate([(src[:20] - mean) @ turn.T + rng.normal(0, 0.05, (20, 2)), rng.uniform(-40, 40, (20, 2))]) + mean + (7, -3)
    best, best_turn = 0, None
    for i, j in itertools.combinations(range(40), 2):
        d = src[j] - src[i]
        gap = dst[None] - dst[:, None]
        for p, q in np.argwhere((np.hypot(*d) >= 8) & (np.abs(np.hypot(gap[..., 0], gap[..., 1]) - np.hypot(*d)) < 0.3)):
            t = np.arctan2(*gap[p, q][::-1]) - np.arctan2(*d[::-1])
            r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
            moved = (src - (src[i] + src[j]) / 2) @ r.T + (dst[p] + dst[q]) / 2
            hits = int((np.hypot(*(moved[:, None] - dst[None]).transpose(2, 0, 1)).min(axis=1) < 0.6).sum())
            if hits > best:
                best, best_turn = hits, r
    flat, hits = register.match_centres_2d(_places(spark, src), _places(spark, dst), draws=300)
    assert np.abs(flat[:2, :2] - turn).max() < 0.01
    assert np.abs(src[:20] @ flat[:2, :2].T + flat[:2, 2] - dst[:20]).max() < 0.4
    # The fit to all pairs may lose a centre that a crooked hypothesis meets by chance.
    assert np.abs(flat[:2, :2] - best_turn).max() < 0.05
    assert hits >= 20 and hits >= best - 1


def test_match_without_a_long_pair(spark):
    close = _places(spark, [(0, 0), (1, 1), (2, 0)])
    with pytest.raises(ValueError, match="long enough"):
        register.match_centres_2d(close, close)
    with pytest.raises(ValueError, match="two objects"):
        register.match_centres_2d(close.limit(1), close)


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles_equal_sorting(spark, parts):
    """One group has nearly all rows, a third of them equal; others have one row, nulls only, or no key."""
    rng = np.random.default_rng(15)
    big = np.where(rng.random(3000) < 0.33, 0.0, rng.normal(0, 5, 3000))
    rows = [(1, float(v), float(-v)) for v in big] + [(2, 4.5, None), (3, None, None), (3, None, None), (None, 1.0, 1.0), (5, 1.0, 2.0), (5, 2.0, 2.0), (5, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g long, v double, w double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        found = order.percentiles(df, ["g"], {"mid": (F.col("v"), 0.5), "high": (F.col("v"), 0.98), "least": (F.col("v"), 0.0), "w9": (F.col("w"), 0.9)})
        got = {r["g"]: r for r in found.collect()}
        assert order.percentiles(df.where("g = 3"), ["g"], {"mid": (F.col("v"), 0.5)}).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == {1, 2, 5}
    want = {"mid": np.quantile(big, 0.5), "high": np.quantile(big, 0.98), "least": big.min(), "w9": np.quantile(-big, 0.9)}
    assert all(got[1][k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    assert (got[2]["mid"], got[2]["high"], got[2]["w9"]) == (4.5, 4.5, None)
    assert got[5]["mid"] == 2.0 and np.isnan(got[5]["high"]) and got[5]["w9"] == 2.0


def test_rule_order(spark):
    df = spark.createDataFrame([(1, -0.5, -1), (2, 0.15, -1), (3, 0.5, -1), (4, 0.05, 0)], "pid long, hag double, instance long")
    got = {r["pid"]: r["label"] for r in labels.rule_labels(df, ["ground", "stump", "other"], 0.12, 0.08).collect()}
    assert got == {1: 0, 2: -1, 3: 2, 4: 1}


def test_config_and_parser(tmp_path):
    base = config.stack([config.paths_of(config.DEFAULTS), [(("reference",), None)]])
    c = config.with_settings(base, ["reference.x=1", "features.scales=[5]", "data={voxel_size: 0.1}"])
    assert c["reference"] == {"x": 1} and c["features"]["scales"] == [5] and config.DEFAULTS["features"]["scales"] == [10, 30]
    assert c["data"]["voxel_size"] == 0.1 and c["data"]["inputs"] == [] and c["features"]["dtm"] == config.DEFAULTS["features"]["dtm"]
    assert config.with_settings({"a": {"b": 1}}, ["a=3", "c={}"]) == {"a": 3, "c": {}} and config.with_settings({"a": {"b": 1}}, ["a={}"]) == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        config.with_settings({}, ["oops"])
    config.save(c, str(tmp_path / "c.yaml"))
    again = config.load(str(tmp_path / "c.yaml"), ["name=field"])
    assert again["features"] == c["features"] and again["work_dir"] == "work/field"
    for args in (["run", "-c", "a"], ["predict", "--checkpoint", "a", "--input", "b", "--output", "c", "--set", "infer.smooth_k=0"], ["demo"], ["evaluate", "-c", "a", "--checkpoint", "r"]):
        assert cli.build_parser().parse_args(args).command == args[0]


def test_hash_of_large_ids(spark):
    from standscan.functions.cloud import portable_hash

    ids = [0, 7, (1 << 31) - 1, 1 << 31, 5 << 40, (1 << 62) + 9]
    got = [r["h"] for r in spark.createDataFrame([(i,) for i in ids], "pid long").select("pid", portable_hash("pid", 3).alias("h")).orderBy("pid").collect()]
    fold = [(i % (1 << 31) + (i >> 31) * 40503) % (1 << 31) for i in ids]
    assert got == [(f * 2654435761 + 3 * 40503) % (1 << 32) for f in fold]


def test_running_total(spark):
    from standscan.operators.order import running_total

    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.col("id").alias("v"))
    got = {r["k"]: r["t"] for r in running_total(df, ["k"], F.col("v"), "t").collect()}
    values = {i * 37 % 500: i for i in range(500)}
    assert got == {k: sum(values[j] for j in range(k + 1)) for k in range(500)}
    assert running_total(df.limit(0), ["k"], F.col("v"), "t").count() == 0


def test_fill_of_a_wide_gap(spark):
    df = spark.range(300).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.when(F.col("id").isin(0, 1, 299), F.col("id").cast("double")).alias("z"))
    got = {r["i"]: r["z"] for r in raster.fill_nearest(df).collect()}
    assert got == {i: 0.0 if i == 0 else 1.0 if i <= 150 else 299.0 for i in range(300)}


def test_pairs_from_either_copied_side(spark):
    rng = np.random.default_rng(12)
    a, b = cloud(spark, rng.uniform(0, 3, (60, 3))), cloud(spark, rng.uniform(0, 3, (80, 3)))
    one, other = ({tuple(r) for r in neighbours.pairs_within(a, b, 0.7, copy_left=c).collect()} for c in (False, True))
    assert one == other and one


def test_painting_and_reference_stumps(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]).withColumns({"hag": F.col("x") * 0.1, "label": F.lit(1), "instance": F.lit(9).cast("bigint")})
    files = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (2, 1, 1.001, 0.0, 0.0)], "pid long, file_ix int, x double, y double, z double")
    everything = spark.createDataFrame([(0, 0, float(i), 0.0, 0.0) for i in range(3)], "pid long, file_ix int, x double, y double, z double").withColumn("pid", F.col("x").cast("long"))
    out = labels.paint_reference(df, [(everything, 0, 0.1), labels.Source(files, 1, 0.1, None, True), labels.Source(everything, 2, 0.1, 0.15)])
    assert [(r["ref_label"], r["ref_instance"]) for r in out.orderBy("pid").collect()] == [(1, 0), (1, 1), (2, -1), (-1, -1)]
    swapped = labels.stumps_from_reference(out, 1, 1, 2).orderBy("pid").collect()
    assert [(r["label"], r["instance"]) for r in swapped] == [(1, 0), (1, 1), (2, -1), (2, -1)]
    report = labels.reference_report(out, {1: 1}, 3)
    assert report["ignored_fraction"] == 0.0 and report["points"]["per_class"][1]["recall"] == 1.0
    assert len(metrics.as_text(report["points"], ["a", "b", "c"]).splitlines()) == 5
    ref = df.select("pid", "x", "y", "z", F.lit(1).alias("label"))
    assert labels.compare_with_reference(df, ref, {1: 1}, 3)["matched_fraction"] == 1.0


def test_selection_and_spread(spark):
    from standscan.operators import models

    df = cloud(spark, [(float(i), 0, 0) for i in range(6)]).withColumns({"bx": F.lit(0), "by": F.lit(0)})
    assert points.subset(df, df.where("pid > 3")).count() == 2
    assert points.select_features(df, ["x"]).columns == ["pid", "x"]
    with pytest.raises(KeyError):
        points.select_features(df, ["no"])
    assert [r["pid"] for r in models.farthest_points(df, 3).orderBy("rank").collect()] == [0, 5, 2]


def test_farthest_points_equal_the_loop(spark):
    """Three blocks: many points with repeated places, one place only, one point."""
    from standscan.operators import models

    rng = np.random.default_rng(16)
    xyz = rng.integers(0, 12, (150, 3)).astype(float)
    rows = [(0, 0, i, *map(float, p)) for i, p in enumerate(xyz)] + [(0, 1, 900 + i, 1.0, 2.0, 3.0) for i in range(4)] + [(1, 0, 950, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "bx int, by int, pid long, x double, y double, z double")
    far, taken = np.full(150, np.inf), [0]
    while len(taken) < 6:
        far = np.minimum(far, ((xyz - xyz[taken[-1]]) ** 2).sum(axis=1))
        taken.append(int(far.argmax()))
    want = [(0, 0, n + 1, p) for n, p in enumerate(taken)] + [(0, 1, 1, 900), (1, 0, 1, 950)]
    assert sorted(map(tuple, models.farthest_points(df, 6).collect())) == want
    assert sorted(map(tuple, models.farthest_points(df, 6, parts=1).collect())) == want
    assert models.farthest_points(df.limit(0), 3).count() == 0


def test_matching_of_a_long_chain(spark):
    n = 260
    chain = lambda shift: spark.createDataFrame([(i, i + shift, 0.0) for i in range(n)], "id long, x double, y double")
    got = {(r["rid"], r["qid"]) for r in metrics.match_centres(chain(0.0), chain(0.5), 0.75).collect()}
    assert got == {(i, i) for i in range(n)}
