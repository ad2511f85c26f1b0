"""Numbered names for a table's own columns, so that working names clash with none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns ``c0, c1, ...``, and the number of each name. No working column has such a name."""
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def restored(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """The columns of :func:`numbered` under their names, and no others."""
    return df.select(*[F.col(n).alias(c) for c, n in own.items()])
