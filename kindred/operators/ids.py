"""Dense integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import materialize


def dense_index(values: DataFrame, column: str, name: str = "index") -> DataFrame:
    """``(column, name)``: position of each distinct value in sorted order, from 0.

    A distributed sort numbers the rows of each partition; the partition offsets come from one count
    per partition. Neither the driver nor a single task sees all values. The sorted table is written
    first, because the numbering of a recomputed sort could differ between two uses.
    """
    ordered = (
        values.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .orderBy(column)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    numbered = (
        materialize(ordered, "dense-index")
        .withColumn("__part", F.shiftright("__at", 33))
        .withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = (
        numbered.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return numbered.join(offsets, "__part").select(column, (F.col("__offset") + F.col("__row")).alias(name))


def with_index(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Attach the dense id of ``column``; rows without one are dropped."""
    return rows.join(index, column)
