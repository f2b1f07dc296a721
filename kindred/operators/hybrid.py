"""Blending of recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.defaults import COLLABORATIVE_MAX, CONTENT_MAX
from kindred.operators.ranking import top_k


def hybrid(
    content: DataFrame,
    collaborative: DataFrame,
    content_max: int = CONTENT_MAX,
    collaborative_max: int = COLLABORATIVE_MAX,
) -> DataFrame:
    """The best of both lists per user: ``(user_id, item_id, score, source, rank)``.

    Both inputs have the columns ``user_id``, ``item_id`` and ``score``.
    """
    def best_of(recommendations: DataFrame, source: str, most: int) -> DataFrame:
        ranked = top_k(
            recommendations.select("user_id", "item_id", "score"),
            ["user_id"],
            [F.desc("score"), F.col("item_id")],
            most,
        )
        return ranked.withColumn("source", F.lit(source))

    return best_of(content, "content", content_max).unionByName(
        best_of(collaborative, "collaborative", collaborative_max)
    )
