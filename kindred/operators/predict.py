"""Rating prediction from nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.defaults import ITEM_NEIGHBOURS, USER_NEIGHBOURS
from kindred.functions.scores import weighted_mean
from kindred.operators.pairs import meet, symmetrise
from kindred.operators.ranking import top_k


def predict_item_based(model: DataFrame, ratings: DataFrame, pairs: DataFrame, k: int = ITEM_NEIGHBOURS) -> DataFrame:
    """Predicted ``stars`` of each (user, item) pair from the k rated items most similar to the item.

    Pairs without a similar rated item get no row.
    """
    wanted = pairs.select("user_id", "item_id").distinct()
    rated = ratings.select("user_id", F.col("item_id").alias("other"), "rating")
    similar = symmetrise(model, "b1", "b2", "item_id", "other")
    votes = meet(wanted, rated, similar, "user_id", "item_id", "other")
    nearest = top_k(votes, ["user_id", "item_id"], [F.desc("sim"), F.col("other")], k)
    return (
        nearest.groupBy("user_id", "item_id")
        .agg(F.round(weighted_mean(F.col("sim"), F.col("rating")), 6).alias("stars"))
        .where(F.col("stars").isNotNull())
    )


def predict_user_based(model: DataFrame, ratings: DataFrame, pairs: DataFrame, k: int = USER_NEIGHBOURS) -> DataFrame:
    """Predicted ``stars``: the user's mean plus the weighted deviations of similar users who rated the item.

    The k most similar users are taken before looking at what they rated. A pair then expands either its user's
    neighbours or its item's raters, whichever are fewer.
    """
    wanted = pairs.select("user_id", "item_id").distinct()
    means = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    neighbours = top_k(
        symmetrise(model, "u1", "u2", "user_id", "other"), ["user_id"], [F.desc("sim"), F.col("other")], k
    ).select("user_id", "other", "sim")
    deviations = ratings.join(means, "user_id").select(
        F.col("user_id").alias("other"), "item_id", (F.col("rating") - F.col("mean")).alias("deviation")
    )
    votes = meet(wanted, neighbours, deviations, "user_id", "item_id", "other")
    return (
        votes.groupBy("user_id", "item_id")
        .agg(weighted_mean(F.col("sim"), F.col("deviation")).alias("shift"))
        .where(F.col("shift").isNotNull())
        .join(means, "user_id")
        .select("user_id", "item_id", F.round(F.col("mean") + F.col("shift"), 6).alias("stars"))
    )


def friends_average(pairs: DataFrame, friends: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean rating of a (user, item) pair's item among the user's friends.

    ``friends`` has the columns ``user_id`` and ``friend_id``.
    """
    wanted = pairs.select("user_id", "item_id").distinct()
    raters = ratings.select(F.col("user_id").alias("friend_id"), "item_id", "rating")
    votes = meet(wanted, friends.select("user_id", "friend_id").distinct(), raters, "user_id", "item_id", "friend_id")
    return votes.groupBy("user_id", "item_id").agg(
        F.round(F.avg("rating"), 6).alias("stars"), F.count(F.lit(1)).alias("n_friends")
    )
