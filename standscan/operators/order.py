"""Running totals, dense numbers and order statistics in a total order, over range partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standscan.session import materialise


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Append the sum of ``value`` over all rows up to each one in ``order``, which must have no ties.

    Rows are range-partitioned by the order. Only the sums of the partitions, a row each, meet
    in one task; they are broadcast as the offsets of the totals within partitions.
    """
    parted = materialise(df.repartitionByRange(*order).withColumns({"ss_part": F.spark_partition_id(), "ss_v": value}), "ordered")
    sums = parted.groupBy("ss_part").agg(F.sum("ss_v").alias("ss_sum"))
    before = sums.select("ss_part", (F.sum("ss_sum").over(W.orderBy("ss_part")) - F.col("ss_sum")).alias("ss_before"))
    within = F.sum("ss_v").over(W.partitionBy("ss_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parted.join(F.broadcast(before), "ss_part").withColumn(out, within + F.col("ss_before")).drop("ss_part", "ss_v", "ss_before")


def percentiles(df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """``(by, names)``: the exact percentile of each wanted ``(value, share)`` by group, between two values in proportion.

    No group meets in one task: equal values are counted before the shuffle, the distinct ones are
    range-partitioned by group and value, and the ranks asked for are looked up only in the partitions
    that hold them, found by the counts of groups in partitions. Nulls are left out; groups with a null key or
    without a value have no row. NaN counts as the largest value.
    """
    key = [*by, "ss_s"]
    each = F.array(*[F.struct(F.lit(i).alias("ss_s"), value.cast("double").alias("ss_x")) for i, (value, _) in enumerate(wanted.values())])
    listed = df.select(*by, F.explode(each).alias("ss_e")).select(*by, "ss_e.*")
    present = F.col("ss_x").isNotNull()
    for b in by:
        present = present & F.col(b).isNotNull()
    counts = listed.where(present).groupBy(*key, "ss_x").agg(F.count("*").alias("ss_c"))
    parted = materialise(counts.repartitionByRange(*key, "ss_x").withColumn("ss_part", F.spark_partition_id()), "percentiles")
    sums = parted.groupBy("ss_part", *key).agg(F.sum("ss_c").alias("ss_sum"))
    before = F.sum("ss_sum").over(W.partitionBy(*key).orderBy("ss_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("ss_sum")
    placed = sums.withColumns({"ss_before": before, "ss_total": F.sum("ss_sum").over(W.partitionBy(*key))})
    shares = F.array(*[F.lit(float(q)) for _, q in wanted.values()])
    at = F.get(shares, F.col("ss_s")) * (F.col("ss_total") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor("ss_at").cast("bigint"), F.ceil("ss_at").cast("bigint"))))
    asked = placed.withColumn("ss_at", at).withColumn("ss_rank", ranks).where("ss_rank >= ss_before and ss_rank < ss_before + ss_sum")
    asked = materialise(asked.select("ss_part", *key, "ss_at", "ss_rank", "ss_before"), "percentile-ranks")
    run = W.partitionBy("ss_part", *key).orderBy("ss_x").rowsBetween(W.unboundedPreceding, 0)
    ranked = parted.join(asked.select("ss_part", *key).distinct(), ["ss_part", *key], "left_semi").withColumn("ss_upto", F.sum("ss_c").over(run))
    here = F.col("ss_rank") - F.col("ss_before")
    found = ranked.join(asked, ["ss_part", *key]).where((here < F.col("ss_upto")) & (here >= F.col("ss_upto") - F.col("ss_c")))
    low, high = F.floor("ss_at").cast("bigint"), F.ceil("ss_at").cast("bigint")
    ends = found.groupBy(*key).agg(F.first("ss_at").alias("ss_at"), F.max(F.when(F.col("ss_rank") == low, F.col("ss_x"))).alias("ss_lo"), F.max(F.when(F.col("ss_rank") == high, F.col("ss_x"))).alias("ss_hi"))
    value = F.when(F.col("ss_lo") == F.col("ss_hi"), F.col("ss_lo")).otherwise((high - F.col("ss_at")) * F.col("ss_lo") + (F.col("ss_at") - low) * F.col("ss_hi"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("ss_s") == i, value)).alias(name) for i, name in enumerate(wanted)])
