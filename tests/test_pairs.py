from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brute import by, random_ratings
from kindred.operators.pairs import PAIRS_PER_TASK, meet, pairs_within, symmetrise


@pytest.mark.parametrize("block_rows", [3, 7, 2048])
def test_pairs_within_blocks(rated, block_rows):
    rows = random_ratings(1, users=12, items=40, per_user=9)
    expected = sorted(
        (u, a, b, items[a], items[b]) for u, items in by(rows, 0, 1).items() for a, b in combinations(sorted(items), 2)
    )
    got = pairs_within(rated(rows), ["user_id"], "item_id", ["rating"], block_rows)
    assert sorted(map(tuple, got.select("user_id", "a", "b", "rating_a", "rating_b").collect())) == expected


def test_hot_key_is_split_over_many_join_keys(rated):
    rows = random_ratings(2, users=3, items=400, per_user=5)
    got = pairs_within(rated(rows), ["user_id"], "item_id", block_rows=50)
    assert got.where(F.col("user_id") == 0).count() == 400 * 399 // 2


def test_meet_equals_plain_join(spark):
    left = [(u, v, float(u + v)) for u in range(10) for v in range(u * 3)]
    right = [(t, v, float(t * v)) for t in range(8) for v in range(0, 30, t + 1)]
    pairs = [(u, t) for u in range(12) for t in range(10)]
    ldf = spark.createDataFrame(left, "u bigint, v bigint, x double")
    rdf = spark.createDataFrame(right, "t bigint, v bigint, y double")
    pdf = spark.createDataFrame(pairs, "u bigint, t bigint")
    got = meet(pdf, ldf, rdf, "u", "t", "v").select("u", "t", "v", "x", "y")
    expected = pdf.join(ldf, "u").join(rdf, ["t", "v"]).select("u", "t", "v", "x", "y")
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(map(tuple, expected.collect()))


def test_symmetrise(spark):
    model = spark.createDataFrame([(1, 2, 0.5)], "b1 bigint, b2 bigint, sim double")
    both = symmetrise(model, "b1", "b2", "item_id", "other")
    assert sorted(map(tuple, both.collect())) == [(1, 2, 0.5), (2, 1, 0.5)]


def test_a_counting_task_stays_small():
    """About 270 bytes a pair (872 MB for 3.3 million, measured): a task of a large table takes no more than 300 MB."""
    assert PAIRS_PER_TASK * 270 <= 300e6
