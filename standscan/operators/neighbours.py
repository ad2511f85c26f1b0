"""Spatial joins: pairs within a radius, nearest and k nearest neighbours.

Where pairs are the result, points are hashed to grid cells as wide as the search radius and one
side is copied to its adjacent cells, so the join has an equality key that Spark can partition, sort
and split when skewed. Where each point needs a few neighbours or sums, tiles are searched instead
(:mod:`standscan.operators.tiles`), and pairs are not written down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import cell
from standscan.operators.tiles import nearest_lists


def _distance2(a: str, b: str, dims: str) -> Column:
    total = None
    for c in dims:
        d = F.col(f"{a}{c}") - F.col(f"{b}{c}")
        total = d * d if total is None else total + d * d
    return total


def pairs_within(left: DataFrame, right: DataFrame, radius, dims: str = "xyz", closed: bool = True, copy_left: bool = False, places: bool = False) -> DataFrame:
    """``(pid, nid, d2)`` of all pairs at most (``closed``) or less than ``radius`` apart.

    The adjacent-cell copies are made of the right side, or of the left one if ``copy_left``;
    it should be the smaller one. ``places`` adds the coordinates of both (``lx``, ``rx``, ...).
    """
    shifts = F.array(*[F.struct(*[F.lit(s).cast("bigint").alias(f"s{c}") for s, c in zip(step, dims, strict=True)]) for step in product((-1, 0, 1), repeat=len(dims))])
    sides = {"l": left.select("pid", *[F.col(c).alias(f"l{c}") for c in dims]), "r": right.select(F.col("pid").alias("nid"), *[F.col(c).alias(f"r{c}") for c in dims])}
    at = {s: [cell(f"{s}{c}", radius) for c in dims] for s in "lr"}
    copied, kept = ("l", "r") if copy_left else ("r", "l")
    a = sides[kept].select("*", *[i.alias(f"c{c}") for i, c in zip(at[kept], dims, strict=True)])
    b = sides[copied].withColumn("s", F.explode(shifts)).withColumns({f"c{c}": i + F.col(f"s.s{c}") for i, c in zip(at[copied], dims, strict=True)}).drop("s")
    d2 = _distance2("l", "r", dims)
    limit = F.lit(radius * radius)
    # Spark takes the copies for as small as the table before them, and would broadcast them
    return a.hint("merge").join(b.hint("merge"), [f"c{c}" for c in dims]).where(d2 <= limit if closed else d2 < limit).select("pid", "nid", d2.alias("d2"), *([f"{s}{c}" for s in "lr" for c in dims] if places else []))


def within_radius(points: DataFrame, targets: DataFrame, radius, dims: str = "xyz") -> DataFrame:
    """The pids of the points that have a target within ``radius``, each once."""
    return pairs_within(points, targets, radius, dims).select("pid").distinct()


def nearest_within(points: DataFrame, targets: DataFrame, bound, dims: str = "xyz", keep: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """``(pid, keep, nid, d2, fields)`` of every point: its nearest target closer than ``bound``, else nulls."""
    near = nearest_lists(points, targets, 1, dims, bound, closed=False, keep=keep, fields=fields)
    return near.select("pid", *dict.fromkeys(keep), *[F.get("near", F.lit(0))[f].alias(f) for f in ("nid", "d2", *fields)])


def k_nearest(points: DataFrame, targets: DataFrame, k: int, start=None, dims: str = "xyz") -> DataFrame:
    """``(pid, nid, d2, rank)``: the exact k nearest targets of each point, ties to the smaller nid.

    Points see all targets if there are fewer than k. ``start``, the width of the first cells, is
    no longer needed: cells follow the density of each tile.
    """
    near = nearest_lists(points, targets, k, dims).select("pid", F.posexplode("near").alias("rank", "n"))
    return near.select("pid", "n.nid", "n.d2", (F.col("rank") + 1).alias("rank"))


def transfer_nearest(points: DataFrame, targets: DataFrame, fields: list[str], start=None, dims: str = "xyz") -> DataFrame:
    """``points`` with ``fields`` of the nearest target, however far it is."""
    near = nearest_lists(points, targets, 1, dims, keep=[c for c in points.columns if c != "pid"], fields=fields)
    return near.where(F.size("near") > 0).select(*points.columns, *[F.get("near", F.lit(0))[f].alias(f) for f in fields])


def smooth(points: DataFrame, k: int, start, fields: list[str]) -> DataFrame:
    """``(pid, fields)`` averaged over each point's k nearest points, itself included; k <= 1 changes nothing."""
    if k <= 1:
        return points.select("pid", *fields)
    near = nearest_lists(points, points, k, fields=fields).where(F.size("near") > 0)
    return near.select("pid", *[(_total(f, lambda n, f=f: n[f].cast("double")) / _total(f, lambda n, f=f: F.lit(1.0))).alias(f) for f in fields])


def _total(field: str, value: Callable[[Column], Column]) -> Column:
    """The sum of ``value`` over the neighbours with ``field``; null if none has it."""
    some = F.filter("near", lambda n: n[field].isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, n: a + value(n)))


def ball_query(centres: DataFrame, points: DataFrame, radius, n: int, dims: str = "xyz") -> DataFrame:
    """``(pid, slot, nid, d2)``: the nearest ``n`` points within ``radius`` of each centre, in order; missing ones repeat the nearest.

    Centres without a point in reach have no rows.
    """
    near = nearest_lists(centres, points, n, dims, radius).where(F.size("near") > 0)
    filled = F.concat("near", F.array_repeat(F.get("near", F.lit(0)), F.lit(n) - F.size("near")))
    return near.select("pid", F.posexplode(filled).alias("slot", "n")).select("pid", "slot", "n.nid", "n.d2")


def interpolate(points: DataFrame, targets: DataFrame, fields: list[str], start=None, k: int = 3, dims: str = "xyz") -> DataFrame:
    """``(pid, fields)``: averages of the ``k`` nearest targets' fields, weighted by ``1 / (d2 + 1e-8)``.

    A target at the point itself outweighs all others; of fewer than ``k`` targets all are used.
    A null field counts as missing with its weight.
    """
    near = nearest_lists(points, targets, k, dims, fields=fields).where(F.size("near") > 0)
    weight = lambda n: 1.0 / (n["d2"] + 1e-8)
    return near.select("pid", *[(_total(f, lambda n, f=f: n[f] * weight(n)) / _total(f, weight)).alias(f) for f in fields])
