"""Spatial splits, sliding blocks, chunks and votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.functions.cloud import cell, portable_hash
from standscan.operators.order import running_total
from standscan.operators.points import origin
from standscan.session import materialise


def spatial_split(cloud: DataFrame, tile, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    """Append ``split`` (0, 1, 2, ...): whole tiles in hashed order, by the midpoint of their running share.

    Midpoints and bounds are compared as exact fractions when the ratios are integers.
    Only the tiles, one row each, are put in order, over range partitions.
    """
    x0, y0 = origin(cloud, ("x", "y"))
    keyed = cloud.withColumns({"ss_i": cell("x", tile, x0), "ss_j": cell("y", tile, y0)})
    tiles = keyed.groupBy("ss_i", "ss_j").agg(F.count("*").alias("n"))
    tiles = tiles.withColumn("ss_h", portable_hash(F.col("ss_i") * 100003 + F.col("ss_j"), seed))
    tiles = materialise(running_total(tiles, ["ss_h", "ss_i", "ss_j"], F.col("n"), "ss_run"), "split-tiles")
    points = tiles.agg(F.sum("n").alias("n")).first()["n"] or 0
    bounds, total = [], sum(ratios)
    for k in range(1, len(ratios)):
        bounds.append(((2 * F.col("ss_run") - F.col("n")) * F.lit(total) > F.lit(2 * sum(ratios[:k]) * points)).cast("int"))
    tiles = tiles.select("ss_i", "ss_j", sum(bounds, F.lit(0)).alias("split"))
    return keyed.join(tiles, ["ss_i", "ss_j"]).drop("ss_i", "ss_j")


def eval_blocks(cloud: DataFrame, block, stride=None, slack=0) -> DataFrame:
    """``(bx, by, pid)``: each point with every window that covers it, by arithmetic, without a join."""
    stride = stride or block
    span = cloud.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = cloud
    for c, b in (("x", "bx"), ("y", "by")):
        lo, hi = span[f"lo{c}"] or 0, span[f"hi{c}"] or 0
        first = lo + block / 2
        n = int(-((first - stride - max(hi, first)) // stride))
        d = F.col(c) - F.lit(lo)
        low = F.greatest(F.lit(0), F.ceil((d - block - slack) / stride)).cast("bigint")
        high = F.least(F.lit(n - 1), F.floor((d + slack) / stride)).cast("bigint")
        out = out.where(low <= high).withColumn(b, F.explode(F.sequence(low, high)))
    return out


def chunks(blocks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Append ``chunk``: the points of a block in hashed order, cut every ``size`` points."""
    w = W.partitionBy("bx", "by").orderBy(portable_hash("pid", seed), "pid")
    return blocks.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def average_votes(votes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average the class columns over all votes of a point; repeated votes count again."""
    return votes.groupBy("pid").agg(*[F.avg(c).alias(c) for c in columns])


def sample_centres(cloud: DataFrame, per_class: int, seed: int = 0, label: str = "label") -> DataFrame:
    """``per_class`` pseudo-random centres of every class, by a rank that Spark trims before its shuffle."""
    w = W.partitionBy(label).orderBy(portable_hash("pid", seed), "pid")
    return cloud.where(F.col(label) >= 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_class).drop("rank")
