import pytest

from brute import random_ratings
from kindred.operators import predict as P
from kindred.operators import similarity as S
from kindred.operators.evaluate import rmse


def pairs_table(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint")


def item_model(spark, rows):
    return spark.createDataFrame(rows, "b1 bigint, b2 bigint, sim double")


def stars(df):
    return {(r["user_id"], r["item_id"]): r["stars"] for r in df.collect()}


def test_fewer_neighbours_than_k(spark, rated):
    ratings = rated([(1, 10, 4.0), (1, 11, 2.0)])
    model = item_model(spark, [(5, 10, 0.5), (5, 11, 0.25)])
    got = stars(P.predict_item_based(model, ratings, pairs_table(spark, [(1, 5), (1, 5), (1, 6), (2, 5)])))
    assert got == {(1, 5): round((0.5 * 4 + 0.25 * 2) / 0.75, 6)}  # no neighbour, no ratings: no row


def test_ties_at_the_last_rank_go_to_the_smaller_id(spark, rated):
    ratings = rated([(1, i, 5.0 if i < 18 else 1.0) for i in range(10, 19)])
    model = item_model(spark, [(5, i, 0.9 if i == 10 else 0.5) for i in range(10, 19)])
    got = stars(P.predict_item_based(model, ratings, pairs_table(spark, [(1, 5)]), k=8))
    assert got == {(1, 5): 5.0}


def test_user_neighbours_are_cut_before_looking_at_the_item(spark, rated):
    ratings = rated([(1, 9, 3.0), (2, 8, 2.0), (3, 7, 5.0), (3, 6, 1.0)])
    model = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "u1 bigint, u2 bigint, sim double")
    wanted = pairs_table(spark, [(1, 7)])
    assert stars(P.predict_user_based(model, ratings, wanted, k=1)) == {}
    assert stars(P.predict_user_based(model, ratings, wanted, k=2)) == {(1, 7): 5.0}


def test_hot_user_and_hot_item_predictions_equal_brute_force(spark, rated):
    rows = random_ratings(11, users=25, items=20, per_user=5)
    ratings = rated(rows)
    model = S.item_similarity(ratings, 2)
    sims = {}
    for r in model.collect():
        sims[r["b1"], r["b2"]] = sims[r["b2"], r["b1"]] = r["sim"]
    mine = {}
    for u, i, r in rows:
        mine.setdefault(u, {})[i] = r
    wanted = [(u, t) for u in range(25) for t in range(20)]
    expected = {}
    for u, t in wanted:
        votes = sorted((-sims[t, j], j) for j in mine[u] if (t, j) in sims)[: P.ITEM_NEIGHBOURS]
        if votes:
            expected[u, t] = sum(-s * mine[u][j] for s, j in votes) / sum(-s for s, _ in votes)
    got = stars(P.predict_item_based(model, ratings, pairs_table(spark, wanted)))
    assert got == pytest.approx(expected, abs=2e-6)


def test_friends(spark, rated):
    ratings = rated([(2, 9, 4.0), (3, 9, 1.0), (4, 9, 5.0)])
    friends = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "user_id bigint, friend_id bigint")
    got = P.friends_average(pairs_table(spark, [(1, 9), (1, 8), (2, 9)]), friends, ratings)
    assert sorted(map(tuple, got.collect())) == [(1, 9, 2.5, 2), (2, 9, 5.0, 1)]


def test_rmse(spark, rated):
    predicted = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0), (7, 7, 1.0)], "user_id bigint, item_id bigint, stars double")
    assert tuple(rmse(predicted, rated([(1, 1, 1.0), (1, 2, 5.0)])).first()) == (1.414214, 2)
