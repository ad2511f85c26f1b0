"""Blocks of a fixed number of points: drawn for training, swept with padding for inference, and varied.

All choices are hashed numbers of keys, so blocks are the same in every run and for every
partitioning. A block's points are numbered over range partitions, not in one task, where a
block may hold any share of the cloud.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.functions.cloud import cell, portable_hash
from standscan.operators.order import running_total
from standscan.session import discard, materialise

HASHES = 1 << 32
MIXING = ((15, 1103515245), (13, 1540483477))  # factors below 2**31 keep the products in 64 bits


def rehash(key: Column, seed: int = 0) -> Column:
    """A hash whose values for neighbouring keys look independent, which those of one product do not."""
    mixed = portable_hash(key, seed)
    for shift, factor in MIXING:
        mixed = (mixed.bitwiseXOR(F.shiftright(mixed, shift)) * F.lit(factor)) % F.lit(HASHES)
    return mixed.bitwiseXOR(F.shiftright(mixed, 16))


def pick(hashed: Column, n: Column | int) -> Column:
    """A place in 0 to n - 1 by the high bits of a hash; n is below 2**31."""
    return F.shiftright(hashed * (F.lit(n) if isinstance(n, int) else n), 32)


def portion(hashed: Column) -> Column:
    """A hash as a number in (0, 1)."""
    return (hashed + 0.5) / F.lit(float(HASHES))


def padded_chunks(blocks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``blocks`` with ``chunk`` and ``slot``: every chunk has ``size`` rows.

    A block's points are cut into chunks in hashed order. The last one is filled up with points of
    the same block, drawn by hashes of its slots; these vote again. Rows are ``(bx, by, pid, ...)``.
    """
    hashed = blocks.withColumn("ss_h", portable_hash("pid", seed))
    numbered = materialise(running_total(hashed, ["bx", "by", "ss_h", "pid"], F.lit(1).cast("bigint"), "ss_at"), "blocks-numbered")
    sizes = materialise(numbered.groupBy("bx", "by").agg(F.min("ss_at").alias("ss_first"), F.count("*").alias("ss_n")), "blocks-sizes")
    ranked = numbered.join(sizes, ["bx", "by"]).withColumn("ss_rank", F.col("ss_at") - F.col("ss_first"))
    own = ranked.withColumns({"chunk": F.floor(F.col("ss_rank") / size).cast("bigint"), "slot": F.pmod(F.col("ss_rank"), F.lit(size)).cast("int")})
    short = sizes.where(F.col("ss_n") % size != 0).withColumn("slot", F.explode(F.sequence((F.col("ss_n") % size).cast("int"), F.lit(size - 1))))
    key = (F.col("bx") * 1009 + F.col("by")) * F.lit(size) + F.col("slot")
    wanted = short.select("bx", "by", F.floor(F.col("ss_n") / size).cast("bigint").alias("chunk"), "slot", pick(rehash(key, seed), F.col("ss_n")).alias("ss_rank"))
    more = ranked.join(wanted, ["bx", "by", "ss_rank"])
    columns = [*blocks.columns, "chunk", "slot"]
    return own.select(*columns).unionByName(more.select(*columns))


def _centres(pools: DataFrame, members: DataFrame, asked: DataFrame, turn: int, tries: int, classes: int, seed: int) -> DataFrame:
    """The drawn centre of every asked sample in this turn: a class by one hash, a point of it by another."""
    key = F.col("sample") * tries + turn
    drawn = asked.select("sample", pick(portable_hash(key, seed), classes).alias("ss_class"), rehash(key, seed).alias("ss_h"))
    placed = drawn.join(pools, "ss_class").select("sample", (F.col("ss_first") + pick(F.col("ss_h"), F.col("ss_n"))).alias("ss_at"))
    return placed.join(members, "ss_at").select("sample", F.lit(turn).alias("turn"), F.col("pid").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"))


def _members(cloud: DataFrame, centres: DataFrame, block) -> DataFrame:
    """``(sample, turn, centre, cx, cy, pid, ...)``: the points within half a block of a centre along x and y.

    The centres, by far the fewer, are copied to the cells of the block's width around them.
    """
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = centres.withColumn("s", around).withColumns({"ss_i": cell("cx", block) + F.col("s.a"), "ss_j": cell("cy", block) + F.col("s.b")}).drop("s")
    at = cloud.withColumns({"ss_i": cell("x", block), "ss_j": cell("y", block)})
    near = (2 * F.abs(F.col("x") - F.col("cx")) <= F.lit(block)) & (2 * F.abs(F.col("y") - F.col("cy")) <= F.lit(block))
    return at.join(spread, ["ss_i", "ss_j"]).where(near).drop("ss_i", "ss_j")


def train_blocks(cloud: DataFrame, block, size: int, samples: int, balanced: bool = True, min_points: int = 128, tries: int = 20, seed: int = 0) -> DataFrame:
    """``samples`` blocks of ``size`` points around labelled points; rows are ``(sample, slot, pid, ...)`` and local coordinates.

    A centre is drawn from a class drawn among those that occur (or, unbalanced, from all labelled
    points), and drawn again, at most ``tries`` times, while its block has fewer than
    ``min_points``; the last one stays. A block's points are taken in hashed order, or, if they
    are fewer than ``size``, drawn by hashes of the slots, with repeats. ``local_x`` and ``local_y``
    count from the centre, ``local_z`` from the lowest point of the whole block. Points with a
    null or negative label are no centres. Without a labelled point there is no block.
    """
    pool = F.col("label") if balanced else F.lit(0)
    labelled = cloud.where("label >= 0").select(pool.alias("ss_label"), "pid", "x", "y").withColumn("ss_h", portable_hash("pid", seed))
    members = materialise(running_total(labelled, ["ss_label", "ss_h", "pid"], F.lit(1).cast("bigint"), "ss_at"), "blocks-members")
    pools = members.groupBy("ss_label").agg(F.min("ss_at").alias("ss_first"), F.count("*").alias("ss_n"))
    # One row a class.
    pools = materialise(pools.withColumn("ss_class", F.row_number().over(W.orderBy("ss_label")).cast("bigint") - 1), "blocks-pools")
    classes = pools.count()
    left = cloud.sparkSession.range(samples if classes else 0).withColumnRenamed("id", "sample")
    settled = []
    for turn in range(tries if classes else 0):
        centres = materialise(_centres(pools, members, left, turn, tries, classes, seed), "blocks-centres")
        sizes = _members(cloud, centres, block).groupBy("sample").agg(F.count("*").alias("n"), F.min("z").alias("floor"))
        judged = materialise(centres.join(sizes, "sample"), "blocks-judged")
        discard(centres)
        enough = F.lit(turn == tries - 1) | (F.col("n") >= min_points)
        settled.append(judged.where(enough))
        left = materialise(judged.where(~enough).select("sample"), "blocks-left")
        if left.isEmpty():
            break
    if not settled:
        extra = {c: F.lit(0).cast("bigint") for c in ("sample", "slot", "n", "centre", "turn")}
        return cloud.limit(0).withColumns(extra | {f"local_{c}": F.lit(0.0) for c in "xyz"})
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    inside = _members(cloud, chosen, block).withColumn("ss_h", portable_hash(F.col("sample") * 7919 + F.col("pid"), seed))
    # Spark trims the ranks in the map tasks, so a block sends at most ``size`` rows from each.
    ranked = inside.withColumn("ss_rank", F.row_number().over(W.partitionBy("sample").orderBy("ss_h", "pid")).cast("bigint") - 1).where(F.col("ss_rank") < size)
    ranked = materialise(ranked, "blocks-ranked")
    full = ranked.where(F.col("n") >= size).withColumn("slot", F.col("ss_rank"))
    slots = chosen.where(F.col("n") < size).select("sample", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("slot"))
    wanted = slots.select("sample", "slot", pick(rehash(F.col("sample") * size + F.col("slot"), seed), F.col("n")).alias("ss_rank"))
    out = full.unionByName(ranked.join(wanted, ["sample", "ss_rank"]).select(*full.columns))
    local = {"local_x": F.col("x") - F.col("cx"), "local_y": F.col("y") - F.col("cy"), "local_z": F.col("z") - F.col("floor")}
    return out.withColumns(local).drop("ss_h", "ss_rank", "cx", "cy", "floor")


def augment(blocks: DataFrame, keys: str = "sample", slot: str = "slot", seed: int = 0, jitter: float = 0.01, clip: float = 0.03) -> DataFrame:
    """The local coordinates turned about z, mirrored and scaled by block, and jittered by point.

    Angle (0 to 2 pi), mirror (one in two) and scale (0.9 to 1.1) are hashes of the block's key,
    jitters are normal numbers from hashes of key and slot, cut at ``clip``. Other columns stay.
    """
    draw = [portion(rehash(F.col(keys) * 3 + i, seed)) for i in range(3)]
    angle, scale = draw[0] * (2 * math.pi), 0.9 + 0.2 * draw[2]
    x = F.col("local_x") * F.cos(angle) - F.col("local_y") * F.sin(angle)
    y = F.col("local_x") * F.sin(angle) + F.col("local_y") * F.cos(angle)
    moved = {"x": F.when(draw[1] < 0.5, -x).otherwise(x), "y": y, "z": F.col("local_z")}
    out = {}
    for i, (c, v) in enumerate(moved.items()):
        at = (F.col(keys) * 100003 + F.col(slot)) * 6 + 2 * i
        normal = F.sqrt(-2 * F.log(portion(rehash(at, seed)))) * F.cos(2 * math.pi * portion(rehash(at + 1, seed)))
        out[f"local_{c}"] = v * scale + F.greatest(F.lit(-clip), F.least(F.lit(clip), normal * jitter))
    return blocks.withColumns(out)
