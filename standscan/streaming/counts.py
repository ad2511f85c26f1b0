"""Streaming forms: columns of a growing survey, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import cell


def column_summary(stream: DataFrame, size, time: str | None = None, delay: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Count, lowest and highest z of each XY column of a stream of points.

    The grid is anchored at 0, as a stream has no known minimum. With ``time`` and
    ``window`` the columns are kept per time window and closed after ``delay``.
    """
    keys = [cell("x", size).alias("i"), cell("y", size).alias("j")]
    if time:
        stream = stream.withWatermark(time, delay)
        keys = [F.window(time, window or delay).alias("window"), *keys]
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
