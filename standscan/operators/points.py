"""Row-wise and grouped operators on point clouds ``(pid, x, y, z, ...)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.functions.cloud import cell, portable_hash

IGNORE = -1


def origin(cloud: DataFrame, cols: Sequence[str] = ("x", "y", "z")) -> tuple:
    """The minima of the coordinates: the anchor of every grid. Zeros for an empty cloud."""
    row = cloud.agg(*[F.min(c).alias(c) for c in cols]).first()
    return tuple(0 if row[c] is None else row[c] for c in cols)


def crop(cloud: DataFrame, bounds: Sequence[float] | None) -> DataFrame:
    """Points in ``[xmin, ymin, xmax, ymax]``, both ends included; None keeps all."""
    if bounds is None:
        return cloud
    x0, y0, x1, y1 = bounds
    return cloud.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def finite(cloud: DataFrame) -> DataFrame:
    """Drop points with a null, NaN or infinite coordinate."""
    keep = F.lit(True)
    for c in "xyz":
        v = F.col(c).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return cloud.where(keep)


def subset(cloud: DataFrame, pids: DataFrame) -> DataFrame:
    """The points whose pid is in ``pids``."""
    return cloud.join(pids.select("pid"), "pid", "left_semi")


def voxel_downsample(cloud: DataFrame, size, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One pseudo-random point of each voxel (and value of ``by``); all points if ``size`` is not positive.

    The representative has the smallest hash of its pid, so partial aggregation leaves one
    row per voxel and task before the shuffle.
    """
    if not size or size <= 0:
        return cloud
    anchor = origin(cloud)
    keys = [cell(c, size, o).alias(f"ss_{c}") for c, o in zip("xyz", anchor, strict=True)]
    kept = F.min_by(F.struct(*cloud.columns), F.struct(portable_hash("pid", seed), F.col("pid"))).alias("p")
    return cloud.groupBy(*keys, *[F.col(c).alias(f"ss_by_{c}") for c in by]).agg(kept).select("p.*")


def rigid_transform(cloud: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Apply a 4x4 matrix to the coordinates."""
    xyz = [F.col(c) for c in "xyz"]
    moved = {c: sum((F.lit(float(row[k])) * xyz[k] for k in range(3)), F.lit(float(row[3]))) for c, row in zip("xyz", matrix[:3], strict=True)}
    return cloud.withColumns(moved)


def union_common(clouds: Sequence[DataFrame]) -> DataFrame:
    """All rows of all clouds on the columns they share, in the first one's order."""
    if len(clouds) == 1:
        return clouds[0]
    shared = [c for c in clouds[0].columns if all(c in d.columns for d in clouds[1:])]
    out = clouds[0].select(*shared)
    for d in clouds[1:]:
        out = out.unionByName(d.select(*shared))
    return out


def feature_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, mean, std)`` with the population deviation; deviations up to 1e-6 count as 1."""
    aggs = [f(F.col(n).cast("double")).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    one = df.agg(*aggs)
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m_{i}").alias("mean"), F.when(F.col(f"s_{i}") > 1e-6, F.col(f"s_{i}")).otherwise(1.0).alias("std")) for i, n in enumerate(names)])).alias("f")
    ).select("f.*")


def standardise(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(v - mean) / std`` of the named columns, as FLOAT."""
    return df.withColumns({n: ((F.col(n) - F.lit(m)) / F.lit(s)).cast("float") for n, (m, s) in stats.items()})


def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such features: {missing}; there are {sorted(df.columns)}")
    return df.select("pid", *[F.col(n).cast("float") for n in names])


def remap_labels(df: DataFrame, mapping: Mapping, source: str, out: str = "label") -> DataFrame:
    """Equality map of a column to class numbers; values outside it become IGNORE."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]) if mapping else F.create_map().cast("map<string,int>")
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(source)), F.lit(IGNORE)).cast("int"))


def top_per_cell(cloud: DataFrame, size, k: int, value: str = "z") -> DataFrame:
    """The k points of highest ``value`` in each XY cell, ties to the smaller pid."""
    x0, y0, _ = origin(cloud)
    w = W.partitionBy("i", "j").orderBy(F.desc(value), "pid")
    ranked = cloud.withColumns({"i": cell("x", size, x0), "j": cell("y", size, y0)}).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def column_features(cloud: DataFrame, size, gap, height: str = "hag") -> DataFrame:
    """Append column_max_hag, column_stack_hag and column_rel_height.

    Heights are reduced to the distinct values of a column, a height starts a new segment
    after a jump above ``gap``, and the stack ends at the top of the lowest segment.
    """
    x0, y0 = origin(cloud, ("x", "y"))
    keyed = cloud.withColumns({"ss_i": cell("x", size, x0), "ss_j": cell("y", size, y0)})
    heights = keyed.select("ss_i", "ss_j", F.col(height).alias("h")).distinct()
    w = W.partitionBy("ss_i", "ss_j").orderBy("h")
    cut = F.when(F.col("h") - F.lag("h").over(w) > gap, 1).otherwise(0)
    stacks = (
        heights.withColumn("cut", cut)
        .withColumn("seg", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("ss_i", "ss_j")
        .agg(F.max("h").alias("column_max_hag"), F.max(F.when(F.col("seg") == 0, F.col("h"))).alias("column_stack_hag"))
    )
    rel = F.when(F.col("column_max_hag") > 1e-3, F.col(height) / F.greatest(F.col("column_max_hag"), F.lit(1e-3))).otherwise(0.0)
    return keyed.join(stacks, ["ss_i", "ss_j"]).withColumn("column_rel_height", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rel)).cast("float")).drop("ss_i", "ss_j")
