"""The engine's inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.ratings import hash_split, ratings_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order line: customer, part, and stars 1 to 5 from the quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_table(purchases(spark, sf_dir), "user_id", "item_id", "stars")


def split_ratings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, hold-out) of the ratings, about 80 to 20."""
    return hash_split(ratings(spark, sf_dir))


# Users and items that the reviews have at least, and documents for each further one.
LEAST_USERS, DOCUMENTS_PER_USER = 97, 50
LEAST_ITEMS, DOCUMENTS_PER_ITEM = 61, 80


def _numbers(docs: DataFrame) -> tuple[Column, Column]:
    """How many users and items the reviews have, as scalar subqueries: they grow with the documents."""
    rows = docs.agg(F.count(F.lit(1)).alias("n"))
    users = rows.select(F.lit(LEAST_USERS) + F.floor(F.col("n") / DOCUMENTS_PER_USER)).scalar()
    return users, rows.select(F.lit(LEAST_ITEMS) + F.floor(F.col("n") / DOCUMENTS_PER_ITEM)).scalar()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text reviews: each document is a review by one user of one item."""
    docs, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    users, items = _numbers(docs)
    return docs.select(
        (doc % users).alias("user_id"),
        ((doc * 7919) % items).alias("item_id"),
        (1 + (doc * 31) % 5).cast("double").alias("stars"),
        "text",
    )


def review_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings_table(reviews(spark, sf_dir), "user_id", "item_id", "stars")


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item) pairs to score; three items and four users among them have no reviews."""
    docs, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    users, items = _numbers(docs)
    return docs.select((doc % (users + 4)).alias("user_id"), ((doc * 104729) % (items + 3)).alias("item_id")).distinct()


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friend lists of three customers each, as one row per friendship of existing customers.

    The lists grow with the customers and not with the square of a group of them.
    """
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    listed = ids.withColumn(
        "friends", F.array(F.col("user_id") + 1, F.col("user_id") + 7, F.floor(F.col("user_id") / 2).cast("bigint"))
    )
    edges = listed.select("user_id", F.explode("friends").alias("friend_id")).where(F.col("user_id") != F.col("friend_id"))
    known = ids.select(F.col("user_id").alias("friend_id"))
    return edges.distinct().join(known, "friend_id", "left_semi").select("user_id", "friend_id")
