from pyspark.sql import functions as F

from kindred.operators import ratings as R
from kindred.operators.ids import dense_index


def reviews(spark, rows):
    return spark.createDataFrame(rows, "user_id string, item_id string, stars double")


def test_duplicate_reviews_are_averaged_once(spark):
    table = R.ratings_table(reviews(spark, [("u", "a", 1.0), ("u", "a", 4.0), ("u", "b", 5.0)]), "user_id", "item_id", "stars")
    assert sorted(map(tuple, table.collect())) == [("u", "a", 2.5), ("u", "b", 5.0)]
    assert R.average_by(table, "user_id").first()["average_stars"] == 3.75
    assert R.global_average(table).first()[0] == 3.75
    assert tuple(R.rating_counts(table).first()) == (2, 1, 2)


def test_long_basket_is_chunked_and_complete(rated):
    table = rated([(1, i, 1.0) for i in range(95)] + [(2, 5, 1.0)])
    rows = R.baskets(table, "user_id", "item_id", chunk_size=10).collect()
    hot = [r for r in rows if r["user_id"] == 1]
    assert all(r["n_members"] == 95 and len(r["members"]) <= 25 for r in hot)
    assert sorted(m for r in hot for m in r["members"]) == list(range(95))
    assert [r["members"] for r in rows if r["user_id"] == 2] == [[5]]


def test_chunks_stay_bounded_where_ids_have_a_stride(spark):
    strided = spark.range(5000).select(F.lit(1).cast("bigint").alias("user_id"), (F.col("id") * 10).alias("item_id"), F.lit(1.0).alias("rating"))
    sizes = [len(r["members"]) for r in R.baskets(strided, "user_id", "item_id", chunk_size=1000).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1200


def test_split_does_not_follow_the_ids(rated):
    """Users of one residue class are split like any others."""
    table = rated([(u * 1000, i, 1.0) for u in range(60) for i in range(50)])
    _, test = R.hash_split(table)
    share = {r["item_id"]: r["count"] / 60 for r in test.groupBy("item_id").count().collect()}
    assert len(share) == 50 and max(share.values()) < 0.5


def test_liked_and_seeds(spark):
    rows = [("u", f"i{k}", 3.0) for k in range(40)] + [("v", "i1", 2.9), ("w", "i1", 5.0), ("w", "i1", 1.0)]
    liked = R.liked_items(reviews(spark, rows))
    assert liked.count() == 41
    assert [tuple(r) for r in R.liked_items(reviews(spark, rows), user="w").collect()] == [("w", "i1")]
    seeds = R.seed_sample(liked)
    again = R.seed_sample(liked.repartition(7))
    assert seeds.where("user_id = 'u'").count() == R.MAX_SEEDS
    assert sorted(map(tuple, seeds.collect())) == sorted(map(tuple, again.collect()))


def test_split_is_a_partition_of_the_table(rated):
    table = rated([(u, i, 1.0) for u in range(60) for i in range(50)])
    train, test = R.hash_split(table)
    assert train.count() + test.count() == 3000
    assert train.join(test, ["user_id", "item_id"]).count() == 0
    assert 0.15 < test.count() / 3000 < 0.25


def test_known_items_are_dropped(rated):
    found = rated([(1, 1, 1.0), (1, 2, 1.0)])
    assert [r["item_id"] for r in R.without_known(found, rated([(1, 1, 5.0), (2, 2, 5.0)])).collect()] == [2]
    everything = R.without_known(found, found)
    assert everything.count() == 0


def test_dense_index_is_the_sorted_position(spark):
    words = [f"w{(k * 7919) % 5000:05d}" for k in range(5000)] + ["w00001", None]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(9)
    got = {r["word"]: r["index"] for r in dense_index(df, "word").collect()}
    assert got == {w: k for k, w in enumerate(sorted({w for w in words if w}))}
