"""The ratings table and the simple aggregates and filters over it.

A ratings table has the columns ``user_id``, ``item_id`` and ``rating``, one row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.defaults import LIKED_FROM, MAX_SEEDS, SEED_SHARE, TEST_SHARE
from kindred.functions.hashing import MIX_RANGE, mix, numeric_id
from kindred.operators.ranking import top_k


def ratings_table(reviews: DataFrame, user: str, item: str, stars: str) -> DataFrame:
    """Mean rating of each (user, item): repeated reviews count once."""
    return (
        reviews.select(
            F.col(user).alias("user_id"),
            F.col(item).alias("item_id"),
            F.col(stars).cast("double").alias("rating"),
        )
        .groupBy("user_id", "item_id")
        .agg(F.avg("rating").alias("rating"))
    )


def average_by(ratings: DataFrame, key: str, name: str = "average_stars") -> DataFrame:
    """Mean rating and number of ratings per user or per item."""
    return ratings.groupBy(key).agg(F.avg("rating").alias(name), F.count(F.lit(1)).alias("n_ratings"))


def global_average(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg("rating").alias("average_stars"))


def rating_counts(ratings: DataFrame) -> DataFrame:
    """Row count, distinct users and distinct items in one row."""
    return ratings.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
    )


def baskets(ratings: DataFrame, key: str, member: str, chunk_size: int = 1000) -> DataFrame:
    """Members of each key as sorted arrays, in numbered chunks of about ``chunk_size``.

    A short basket is one chunk. A hot key gets as many chunks as it needs, so no task ever gathers a
    whole unbounded basket into one row.
    """
    distinct = ratings.select(key, member).distinct()
    number = numeric_id(F.col(member), dict(ratings.dtypes)[member])
    sizes = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))
    chunks = F.ceil(F.col("n_members") / chunk_size)
    return (
        distinct.join(sizes, key)
        .withColumn("chunk", mix(number, F.lit(0)) % chunks)
        .groupBy(key, "n_members", "chunk")
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
    )


def liked_items(reviews: DataFrame, threshold: float = LIKED_FROM, user: object | None = None) -> DataFrame:
    """Distinct (user, item) with at least one review of ``threshold`` stars; of one user if given."""
    liked = reviews.where(F.col("stars") >= threshold)
    if user is not None:
        liked = liked.where(F.col("user_id") == F.lit(user))
    return liked.select("user_id", "item_id").distinct()


def pair_mix(df: DataFrame, left: str = "user_id", right: str = "item_id") -> Column:
    """Reproducible pseudo-random integer of a pair of ids."""
    types = dict(df.dtypes)
    return mix(numeric_id(F.col(left), types[left]), numeric_id(F.col(right), types[right]))


def seed_sample(liked: DataFrame, share: float = SEED_SHARE, at_most: int = MAX_SEEDS) -> DataFrame:
    """A sample of each user's liked items: a share of them, at most a few.

    Chosen by a hash of the pair rather than by a random generator, so a lost task that runs again
    takes the same rows.
    """
    mixed = liked.withColumn("mix", pair_mix(liked))
    sampled = mixed.where(F.col("mix") < F.lit(int(share * MIX_RANGE)))
    return top_k(sampled, ["user_id"], [F.col("mix"), F.col("item_id")], at_most).select("user_id", "item_id")


def hash_split(ratings: DataFrame, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the pair: reproducible, and any SQL engine can repeat it."""
    bound = F.lit(int(test_share * MIX_RANGE))
    mixed = pair_mix(ratings)
    return ratings.where(mixed >= bound), ratings.where(mixed < bound)


def without_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Drop (user, item) rows the user has already reviewed."""
    return candidates.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def with_average(entities: DataFrame, averages: DataFrame, key: str) -> DataFrame:
    """Entities that have an average, with it."""
    return entities.join(averages, key)


def with_details(recommendations: DataFrame, details: DataFrame, key: str = "item_id") -> DataFrame:
    """Attach the descriptive columns of the items."""
    return recommendations.join(details, key)
