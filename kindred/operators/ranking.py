"""Top-k per group and global top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Written as ``row_number() <= k`` so that Spark limits each group before the shuffle as well
    (WindowGroupLimit); a hot group therefore sends at most k rows per map task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def best(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table (a distributed take-ordered)."""
    return df.orderBy(*order).limit(n)
