"""The integer-millimetre point cloud derived from the ``events`` table, and shared expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs unchanged in Spark SQL and DuckDB.
CLOUD_COLUMNS = (
    "event_id as pid",
    "(event_id*7919 + user_id*104729) % 10000 as x",
    "(event_id*6101 + user_id*31337 + cast(round(value*100) as bigint)*271) % 10000 as y",
    "(event_id*6101 + user_id*17) % (case event_type when 'view' then 120 when 'click' then 400 when 'purchase' then 900 when 'signup' then 2500 else 6000 end) as z",
    "cast(case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 2 else -1 end as int) as label",
)
CLOUD_SQL = f"cloud as (select {', '.join(CLOUD_COLUMNS)} from events)"


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, x, y, z`` (BIGINT, mm) and ``label`` (INT, -1 = ignore)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*CLOUD_COLUMNS)


def portable_hash(col: str | Column, seed: int = 0) -> Column:
    """An integer hash that other SQL engines can repeat; ``col`` must not be negative.

    Numbers from 2**31 on are folded below it first, so that no product leaves 64 bits.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("bigint")
    c = (c % F.lit(1 << 31) + F.shiftright(F.abs(c), 31) * F.lit(40503)) % F.lit(1 << 31)
    return (c * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)


def cell(col: str | Column, size, origin=0) -> Column:
    """The index of the grid cell of a coordinate."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor((c - F.lit(origin)) / F.lit(size)).cast("bigint")


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    e = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """The place of the first maximum of an array, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def symmetric_eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix in descending order, by the trigonometric method."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (2 * p * p * p)).otherwise(F.lit(0.0))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    l1 = q + 2 * p * F.cos(phi)
    l3 = q + 2 * p * F.cos(phi + F.lit(2.0943951023931953))
    return l1, 3 * q - l1 - l3, l3


def smallest_direction(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column, l3: Column) -> Column:
    """The unit eigenvector of the smallest eigenvalue: the longest cross product of two rows of C - l3 I."""
    rows = [(xx - l3, xy, xz), (xy, yy - l3, yz), (xz, yz, zz - l3)]

    def cross(a, b):
        return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    crosses = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.array_max(F.array(*[F.struct((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("n"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z")) for c in crosses]))
    norm = F.sqrt(best["n"])
    return F.when(best["n"] > 0, F.struct((best["x"] / norm).alias("x"), (best["y"] / norm).alias("y"), (best["z"] / norm).alias("z"))).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")))
