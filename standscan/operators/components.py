"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.session import discard, materialise


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Tie each node's neighbours to the smallest of them.

    The minima are aggregated map-side first and written, so that a hub's rows meet
    in an ordinary sort-merge join, which adaptive execution can split.
    """
    mins = materialise(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-min")
    joined = edges.join(mins, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    result = materialise(out.where("u <> v").distinct(), "cc-star")
    discard(mins)
    return result


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest node.

    Nulls and self-loops are ignored, repeated and reversed edges count once, and an
    empty input gives an empty result. Nodes may be of any type that Spark orders.
    Each half-round is one shuffle join written to the shared folder; stars halve their
    depth each round, so the number of rounds follows the logarithm of the diameter.
    """
    a, b = F.col(src), F.col(dst)
    cur = materialise(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "cc-edges",
    )
    seen = _fingerprint(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        nxt = _star(large, small=True)
        discard(large)
        discard(cur)
        cur, last, seen = nxt, seen, _fingerprint(nxt)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
