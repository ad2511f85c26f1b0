"""Terrain rasters ``(i, j, z)``: minimum raster, nearest fill, grey morphology, smoothing, interpolation.

Sliding minima and maxima are window frames that are cut off at the raster's edge, which
equals reflecting it. Rows of one line (or column) form a partition, so wide surveys spread
over tasks without halos.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.functions.cloud import cell
from standscan.operators.points import origin
from standscan.session import materialise


def min_raster(cloud: DataFrame, size, anchor: tuple) -> DataFrame:
    """The lowest z of each occupied cell."""
    return cloud.groupBy(cell("x", size, anchor[0]).alias("i"), cell("y", size, anchor[1]).alias("j")).agg(F.min("z").alias("z"))


def dense(raster: DataFrame) -> DataFrame:
    """All cells from (0, 0) to the largest indices; cells that were absent have a null z."""
    span = raster.agg(F.max("i").alias("ni"), F.max("j").alias("nj")).where("ni is not null")
    top = span.first()
    wide, high = (0, 0) if top is None else (top["ni"] + 1, top["nj"] + 1)
    grid = raster.sparkSession.range(wide * high).select(F.expr(f"id div {max(high, 1)}").alias("i"), (F.col("id") % max(high, 1)).alias("j"))
    return grid.join(raster, ["i", "j"], "left")


def fill_nearest(raster: DataFrame) -> DataFrame:
    """Give each null cell the z of the nearest valid cell, ties to the smaller (i, j).

    Rings of growing width are joined by equality on shifted indices; a cell is settled when
    the nearest valid cell found is no farther than the ring's half-width, and rounds go on
    until all are. Only valid cells beside a null one are searched, as any other has such a
    cell on the way to it. Raises ValueError for a raster with cells but no valid one.
    """
    valid = materialise(raster.where("z is not null"), "fill-valid")
    holes = materialise(raster.where("z is null").select("i", "j"), "fill-holes")
    if holes.isEmpty():
        return raster
    if valid.isEmpty():
        raise ValueError("the raster has no valid cells")
    ring = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    beside = holes.withColumn("s", F.explode(ring)).select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct()
    shore = materialise(valid.join(beside, ["i", "j"], "left_semi"), "fill-shore")
    done, left, half = [valid.select("i", "j", "z")], holes, 1
    while True:
        v = shore.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "z", F.floor(F.col("i") / half).alias("bi"), F.floor(F.col("j") / half).alias("bj"))
        h = left.withColumn("s", F.explode(ring)).select("i", "j", (F.floor(F.col("i") / half) + F.col("s.a")).alias("bi"), (F.floor(F.col("j") / half) + F.col("s.b")).alias("bj"))
        di, dj = F.col("i") - F.col("vi"), F.col("j") - F.col("vj")
        best = h.join(v, ["bi", "bj"]).groupBy("i", "j").agg(F.min(F.struct((di * di + dj * dj).alias("d2"), "vi", "vj", "z")).alias("b"))
        best = materialise(best.where(F.col("b.d2") <= half * half).select("i", "j", F.col("b.z").alias("z")), "fill-found")
        done.append(best)
        left = materialise(left.join(best, ["i", "j"], "left_anti"), "fill-left")
        if left.isEmpty():
            break
        half *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _slide(raster: DataFrame, size: int, fn) -> DataFrame:
    half = size // 2
    over_i = W.partitionBy("j").orderBy("i").rowsBetween(-half, half)
    over_j = W.partitionBy("i").orderBy("j").rowsBetween(-half, half)
    return raster.withColumn("z", fn("z").over(over_i)).withColumn("z", fn("z").over(over_j))


def erode(raster: DataFrame, size: int) -> DataFrame:
    return _slide(raster, size, F.min)


def dilate(raster: DataFrame, size: int) -> DataFrame:
    return _slide(raster, size, F.max)


def opening(raster: DataFrame, size: int) -> DataFrame:
    return dilate(erode(raster, size), size)


def closing(raster: DataFrame, size: int) -> DataFrame:
    return erode(dilate(raster, size), size)


def remove_pits(raster: DataFrame, depth) -> DataFrame:
    """Replace cells more than ``depth`` below their 3x3 closing by it."""
    closed = closing(raster, 3).withColumnRenamed("z", "c")
    return raster.join(closed, ["i", "j"]).select("i", "j", F.when(F.col("c") - F.col("z") > depth, F.col("c")).otherwise(F.col("z")).alias("z"))


def window_steps(size, windows: Sequence[float], dh0, slope) -> list[tuple[int, float]]:
    """``(odd width in cells, height threshold)`` of each round."""
    steps, last = [], 0.0
    for n, w in enumerate(sorted(windows)):
        steps.append((max(3, int(round(w / size)) | 1), dh0 if n == 0 else dh0 + slope * (w - last)))
        last = w
    return steps


def ground_flags(raster: DataFrame, steps: list[tuple[int, float]]) -> DataFrame:
    """``(i, j, z, ground)``: false where an opening of growing width drops by more than its threshold."""
    state = raster.select("i", "j", "z", F.col("z").alias("s"), F.lit(True).alias("ground"))
    for n, (width, drop) in enumerate(steps):
        opened = opening(state.select("i", "j", F.col("s").alias("z")), width).withColumnRenamed("z", "o")
        state = state.join(opened, ["i", "j"]).select("i", "j", "z", F.col("o").alias("s"), (F.col("ground") & ~(F.col("s") - F.col("o") > drop)).alias("ground"))
        state = materialise(state, f"ground-{n}")
    return state.drop("s")


def gaussian(raster: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian of radius ``int(4 sigma + 0.5)`` cells, reflected at the edges."""
    if sigma <= 0:
        return raster
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-radius, radius + 1), weights, strict=True)])
    span = raster.agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj")).first()
    for axis, n in (("i", span["ni"]), ("j", span["nj"])):
        other = "j" if axis == "i" else "i"
        at = F.pmod(F.col(axis) + F.col("t.k"), F.lit(2 * n))
        source = F.when(at < n, at).otherwise(2 * n - 1 - at)
        spread = raster.select("i", "j").withColumn("t", F.explode(taps)).select("i", "j", source.alias("src"), F.col("t.w").alias("w"))
        values = raster.select(F.col(axis).alias("src"), F.col(other).alias("o"), "z")
        raster = spread.withColumn("o", F.col(other)).join(values, ["src", "o"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col("z")).alias("z"))
    return raster


@dataclass
class Terrain:
    """A raster with the anchor and cell size of its grid."""

    raster: DataFrame
    x0: float
    y0: float
    size: float

    def add_height(self, cloud: DataFrame, out: str = "hag") -> DataFrame:
        """Append the height above the bilinear surface, clamped to the raster's edge.

        Points are joined to the four cells around them by cell index; points that share a
        cell share the lookup.
        """
        span = self.raster.agg(F.max("i").alias("ni"), F.max("j").alias("nj")).first()
        u, v = (F.col("x") - F.lit(self.x0)) / F.lit(self.size) - 0.5, (F.col("y") - F.lit(self.y0)) / F.lit(self.size) - 0.5
        u, v = F.greatest(F.lit(0.0), F.least(F.lit(float(span["ni"])), u)), F.greatest(F.lit(0.0), F.least(F.lit(float(span["nj"])), v))
        located = cloud.withColumns({"ss_u": u, "ss_v": v}).withColumns({"ss_i": F.floor("ss_u").cast("bigint"), "ss_j": F.floor("ss_v").cast("bigint")})
        r = self.raster
        corners = r.select(F.col("i").alias("ss_i"), F.col("j").alias("ss_j"), F.col("z").alias("z00"))
        for name, a, b in (("z10", 1, 0), ("z01", 0, 1), ("z11", 1, 1)):
            moved = r.select((F.col("i") - a).alias("ss_i"), (F.col("j") - b).alias("ss_j"), F.col("z").alias(name))
            corners = corners.join(moved, ["ss_i", "ss_j"], "left")
        joined = located.join(corners, ["ss_i", "ss_j"])
        fu, fv = F.col("ss_u") - F.col("ss_i"), F.col("ss_v") - F.col("ss_j")
        z10, z01 = F.coalesce("z10", "z00"), F.coalesce("z01", "z00")
        z11 = F.coalesce("z11", "z10", "z01", "z00")
        ground = F.col("z00") * (1 - fu) * (1 - fv) + z10 * fu * (1 - fv) + z01 * (1 - fu) * fv + z11 * fu * fv
        return joined.withColumn(out, (F.col("z") - ground).cast("float")).drop("ss_u", "ss_v", "ss_i", "ss_j", "z00", "z10", "z01", "z11")


def fit_terrain(cloud: DataFrame, size: float = 0.5, windows: Sequence[float] = (1.0, 2.0, 4.0), dh0: float = 0.15, slope: float = 0.3, smooth: float = 1.0) -> Terrain:
    """Progressive morphological ground filter over the minimum raster, refilled and smoothed."""
    x0, y0 = origin(cloud, ("x", "y"))
    filled = materialise(fill_nearest(dense(min_raster(cloud, size, (x0, y0)))), "terrain-filled")
    level = materialise(remove_pits(filled, dh0), "terrain-level")
    flags = ground_flags(level, window_steps(size, windows, dh0, slope))
    refilled = materialise(fill_nearest(flags.select("i", "j", F.when(F.col("ground"), F.col("z")).alias("z"))), "terrain-refilled")
    return Terrain(materialise(gaussian(refilled, smooth), "terrain"), x0, y0, size)
