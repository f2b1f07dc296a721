"""Every registered query, by name. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import defaults as D
from kindred.operators import content as C
from kindred.operators import evaluate as E
from kindred.operators import factorization as A
from kindred.operators import hybrid as H
from kindred.operators import minhash as M
from kindred.operators import predict as P
from kindred.operators import ratings as R
from kindred.operators import similarity as S
from kindred.operators import text as X
from kindred.operators.features import TextFeatures, WordWeights, cleaner, vector_entries, words_of
from kindred.operators.ids import dense_index, with_index
from kindred.operators.keyword_index import KeywordIndex
from kindred.operators.vector_index import VectorIndex
from kindred.operators.vectors import similar_items
from kindred.plans import tables as T
from kindred.session import materialize, scratch_path
from kindred.sources import tables as IO

Query = Callable[[SparkSession, str], DataFrame]

# The stopwords of the registered text queries.
STOPWORDS = (
    "the of and to in is that it for on was with be as by this are at an from "
    "de la le les des et un une en que el los las y der die das und den von"
).split()
SEARCH_TEXT = "Thatin, threen ononst: hetition & the ereden 42 achte!"
# Rows per band of the registered candidates: 25 bands of two rows.
LSH_ROWS = 2
# The bands that find item pairs, and user pairs above the same similarity, with the default recall.
LSH_PLAN = M.plan_bands(D.MIN_JACCARD_ITEMS)
RARE_SHARE = 1e-5


def _stopwords(spark: SparkSession) -> DataFrame:
    return X.stopword_table(spark, STOPWORDS)


def _rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


# --- ratings -------------------------------------------------------------------------------------


def ratings_utility(spark, sf):
    return T.ratings(spark, sf).withColumn("rating", F.round("rating", 6))


def _average(key: str) -> Query:
    def query(spark, sf):
        return R.average_by(T.ratings(spark, sf), key).withColumn("average_stars", F.round("average_stars", 6))

    return query


def global_avg(spark, sf):
    return R.global_average(T.ratings(spark, sf)).withColumn("average_stars", F.round("average_stars", 6))


def rating_counts(spark, sf):
    return R.rating_counts(T.ratings(spark, sf))


def _baskets(key: str, member: str) -> Query:
    def query(spark, sf):
        listed = R.baskets(T.ratings(spark, sf), key, member)
        return listed.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))

    return query


def users_with_average(spark, sf):
    averages = R.average_by(T.ratings(spark, sf), "user_id").withColumn("average_stars", F.round("average_stars", 6))
    users = T.users(spark, sf).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return R.with_average(users, averages, "user_id")


def liked_items(spark, sf):
    return R.liked_items(T.purchases(spark, sf))


def liked_items_sql(spark, sf):
    """The same through a view and SQL text."""
    IO.register_views(reviews=T.purchases(spark, sf))
    return spark.sql("SELECT DISTINCT user_id, item_id FROM reviews WHERE stars >= 3.0")


def seed_sample(spark, sf):
    return R.seed_sample(R.liked_items(T.purchases(spark, sf)))


def holdout_split(spark, sf):
    train, test = T.split_ratings(spark, sf)
    part = lambda df, name: df.select("user_id", "item_id", F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


def dense_ids(spark, sf):
    ratings = _ratings(spark, sf)
    users = dense_index(ratings, "user_id", "user_index")
    items = dense_index(ratings, "item_id", "item_index")
    return with_index(with_index(ratings, users, "user_id"), items, "item_id").select(
        "user_id", "item_id", "user_index", "item_index"
    )


# --- similarity and prediction -------------------------------------------------------------------
# These plans read the ratings many times, so the join and the averaging behind them are done once.


def _ratings(spark, sf) -> DataFrame:
    return materialize(T.ratings(spark, sf), "ratings")


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    return R.hash_split(_ratings(spark, sf))


def co_rating_pairs(spark, sf):
    return S.co_rating_counts(_ratings(spark, sf), "user_id", "item_id")


def item_pearson(spark, sf):
    return S.item_similarity(_ratings(spark, sf))


def user_pearson(spark, sf):
    return S.user_similarity(_ratings(spark, sf), lsh=False)


def minhash_signatures(spark, sf):
    signatures = M.minhash_signatures(T.ratings(spark, sf), "user_id", "item_id")
    return M.signature_rows(signatures, "user_id").withColumn("k", F.col("k").cast("bigint"))


def lsh_buckets(spark, sf):
    buckets = M.lsh_buckets(M.minhash_signatures(T.ratings(spark, sf), "user_id", "item_id"), "user_id")
    return M.bucket_sizes(buckets).withColumn("band", F.col("band").cast("bigint"))


def lsh_candidates(spark, sf):
    signatures = M.minhash_signatures(_ratings(spark, sf).select("user_id", "item_id"), "user_id", "item_id")
    return M.lsh_candidates(signatures, "user_id", LSH_ROWS)


def lsh_co_raters(spark, sf):
    return S.lsh_co_raters(_ratings(spark, sf), "item_id", "user_id")


def lsh_verified_jaccard(spark, sf):
    return S.item_jaccard(_ratings(spark, sf))


def lsh_user_pearson(spark, sf):
    return S.user_similarity(_ratings(spark, sf))


def lsh_user_pearson_search(spark, sf):
    """The user model by search; at its low threshold no search of 50 functions pays, and it is the exact one."""
    return S.user_similarity_search(_ratings(spark, sf))


def _lsh_recall(entity: str, member: str) -> Query:
    """Share of the pairs above the threshold that the planned bands find, and what finding them costs: the pairs in
    buckets beside those of an exact join."""

    def query(spark, sf):
        baskets = _ratings(spark, sf).select(entity, member)
        profiles = M.minhash_signatures(baskets, entity, member, hashes=LSH_PLAN.rows * LSH_PLAN.bands)
        profiles = materialize(profiles, "signatures")
        exact = S.jaccard_pairs(baskets, entity, member, D.MIN_JACCARD_ITEMS)
        found = E.recall(M.lsh_candidates(profiles, entity, LSH_PLAN.rows), exact, "a", "b")
        n = F.count(F.lit(1))
        met = lambda rows, key: rows.groupBy(*key).agg((n * (n - 1) / 2).cast("bigint").alias("n")).agg(F.sum("n"))
        in_buckets = met(M.lsh_buckets(profiles, entity, LSH_PLAN.rows), ["band", "bucket"]).scalar()
        return found.withColumns({"n_bucket_pairs": in_buckets, "n_join_pairs": met(baskets, [member]).scalar()})

    return query


def lsh_confirmed_recall(spark, sf):
    """What bands of one row leave of all pairs above the threshold."""
    ratings = _ratings(spark, sf)
    scored = materialize(S.scored_items(ratings), "scored-items")  # both models are made of the same pairs
    return E.recall(S.item_jaccard(ratings, scored=scored), S.item_jaccard(ratings, lsh=False, scored=scored), "b1", "b2")


def lsh_sampled_recall(spark, sf):
    """Whether a recall estimated from a fifth of the items has the exact one between its bounds."""
    baskets = _ratings(spark, sf).select("item_id", "user_id")
    profiles = materialize(M.minhash_signatures(baskets, "item_id", "user_id", hashes=LSH_PLAN.rows * LSH_PLAN.bands), "signatures")
    # Not written: most candidates are left out again where they are made.
    found = M.lsh_candidates(profiles, "item_id", LSH_PLAN.rows)
    exact = E.recall(found, S.jaccard_pairs(baskets, "item_id", "user_id", D.MIN_JACCARD_ITEMS), "a", "b").select("n_exact", F.col("recall").alias("true_recall"))
    estimate = E.sampled_recall(found, baskets, "item_id", "user_id", D.MIN_JACCARD_ITEMS, 0.2, z=4.0)
    exact = materialize(exact, "exact-recall")  # one row
    true = exact.select("true_recall").scalar()
    inside = (F.col("low") <= true) & (true <= F.col("high"))
    return estimate.select(exact.select("n_exact").scalar().alias("n_exact"), true.alias("true_recall"), inside.alias("inside"))


def item_predict(spark, sf):
    train, test = _split(spark, sf)
    return P.predict_item_based(materialize(S.item_similarity(train), "item-model"), train, test)


def user_predict(spark, sf):
    train, test = _split(spark, sf)
    return P.predict_user_based(materialize(S.user_similarity(train), "user-model"), train, test)


def item_predict_rmse(spark, sf):
    train, test = _split(spark, sf)
    return E.rmse(P.predict_item_based(materialize(S.item_similarity(train), "item-model"), train, test), test)


def user_predict_rmse(spark, sf):
    train, test = _split(spark, sf)
    return E.rmse(P.predict_user_based(materialize(S.user_similarity(train), "user-model"), train, test), test)


def friends_avg(spark, sf):
    train, test = _split(spark, sf)
    return P.friends_average(test, T.friends(spark, sf), train)


# --- text ----------------------------------------------------------------------------------------


def tokens(spark, sf):
    return X.tokenize(T.reviews(spark, sf), _stopwords(spark))


def term_counts_without_digits(spark, sf):
    return X.term_counts(X.tokenize(T.reviews(spark, sf), _stopwords(spark), keep=("item_id",), remove_digits=True))


def _counts(spark, sf) -> DataFrame:
    return X.term_counts(X.tokenize(T.reviews(spark, sf), _stopwords(spark), keep=("item_id",)))


def term_freq(spark, sf):
    counts = materialize(_counts(spark, sf), "term-counts")
    return X.term_frequencies(counts).withColumn("tf", F.round("tf", 9))


def doc_freq_idf(spark, sf):
    idf = X.inverse_frequencies(_counts(spark, sf), X.item_count(T.reviews(spark, sf)))
    return idf.withColumn("idf", F.round("idf", 9))


def rare_words(spark, sf):
    return X.rare_words(materialize(_counts(spark, sf), "term-counts"), RARE_SHARE)


def _profiles(spark, sf, **options) -> DataFrame:
    return X.item_profiles(T.reviews(spark, sf), _stopwords(spark), **options)


def item_profile_top200(spark, sf):
    return _rank(_profiles(spark, sf))


def item_profile_frequent(spark, sf):
    """Profiles after dropping the rare words."""
    return _rank(_profiles(spark, sf, rare_share=RARE_SHARE))


def user_profile(spark, sf):
    return X.user_profiles(T.reviews(spark, sf), _profiles(spark, sf))


def vocab_index(spark, sf):
    return X.vocabulary(_profiles(spark, sf))


def content_scores(spark, sf):
    reviews = T.reviews(spark, sf)
    items = materialize(_profiles(spark, sf), "item-profiles")
    users = materialize(X.user_profiles(reviews, items), "user-profiles")
    pairs = C.with_both_profiles(T.review_pairs(spark, sf), items, users)
    return C.content_scores(pairs, items, users)


def keyword_search(spark, sf):
    return C.keyword_search(SEARCH_TEXT, materialize(_profiles(spark, sf), "item-profiles"))


def keyword_index_search(spark, sf):
    """The same search in an index of the profiles' words."""
    index = KeywordIndex.build(_profiles(spark, sf), scratch_path(spark, "keyword-index"))
    return index.search(SEARCH_TEXT)


# --- vectors -------------------------------------------------------------------------------------


def vector_cosine_topn(spark, sf):
    vectors = T.item_vectors(spark, sf)
    return _rank(similar_items(vectors.select("item_id"), vectors, D.SIMILAR_PER_SEED))


def content_recommend(spark, sf):
    return _rank(C.content_recommendations(T.reviews(spark, sf), T.item_vectors(spark, sf)))


def item_details(spark, sf):
    """Content recommendations with what is known about the items."""
    return R.with_details(content_recommend(spark, sf), T.item_details(spark, sf))


def hybrid_union(spark, sf):
    """Content recommendations blended with item-based predictions for pairs without a review."""
    ratings = materialize(T.review_ratings(spark, sf), "review-ratings")
    unseen = R.without_known(T.review_pairs(spark, sf), ratings)
    predicted = P.predict_item_based(materialize(S.item_similarity(ratings), "item-model"), ratings, unseen)
    return _rank(H.hybrid(content_recommend(spark, sf), predicted.withColumnRenamed("stars", "score")))


# --- files ---------------------------------------------------------------------------------------


def _business(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("item_id"), "stars")


def reviews_json(spark, sf):
    """Reviews written as JSON lines and read back with the stated schema."""
    path = scratch_path(spark, "reviews-json")
    reviews = T.reviews(spark, sf)
    IO.write_json(
        reviews.withColumn("user_id", F.col("user_id").cast("string")).withColumn("item_id", F.col("item_id").cast("string")),
        path,
    )
    return IO.read_json(spark, path, D.REVIEW)


def average_map_file(spark, sf):
    path = scratch_path(spark, "item-average")
    averages = R.average_by(T.ratings(spark, sf), "item_id")
    IO.write_average_map(averages, "item_id", "average_stars", path)
    return IO.read_average_map(spark, path, "item_id").withColumn("average_stars", F.round("average_stars", 6))


def similarity_model_file(spark, sf):
    """The item model written as JSON lines and read back."""
    path = scratch_path(spark, "item-model")
    IO.write_json(S.item_similarity(_ratings(spark, sf)), path)
    return IO.read_json(spark, path, D.ITEM_MODEL)


def item_predict_from_file(spark, sf):
    """Predictions by a program that has only the model's file and the ratings."""
    train, test = _split(spark, sf)
    path = scratch_path(spark, "item-model")
    IO.write_json(S.item_similarity(train), path)
    model = IO.read_json(spark, path, D.ITEM_MODEL).select(F.col("b1").cast("bigint"), F.col("b2").cast("bigint"), "sim")
    return P.predict_item_based(model, train, test)


def predictions_file(spark, sf):
    path = scratch_path(spark, "predictions")
    IO.write_json(_business(item_predict(spark, sf)), path)
    return IO.read_json(spark, path, D.PREDICTION)


def profile_file(spark, sf):
    path = scratch_path(spark, "profiles")
    IO.write_profiles(_profiles(spark, sf), "item_id", "word", path)
    return IO.read_profiles(spark, path, "item_id", "word")


def profiles_parquet(spark, sf):
    path = scratch_path(spark, "profiles-parquet")
    IO.write_parquet(user_profile(spark, sf), path)
    return IO.read_parquet(spark, path)


# --- machine learning ----------------------------------------------------------------------------


def _indexed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    indexed, users, items = A.index_ratings(_ratings(spark, sf))
    return materialize(indexed, "indexed-ratings"), users, items


def als_holdout(spark, sf):
    """RMSE of the tuned model on the hold-out, after saving and loading it."""
    indexed, _, _ = _indexed(spark, sf)
    train, test = R.hash_split(indexed)
    path = scratch_path(spark, "als-model")
    A.fit_als(train).write().overwrite().save(path)
    return E.rmse(A.predict_als(ALSModel.load(path), test), test)


def als_recommend(spark, sf):
    indexed, users, items = _indexed(spark, sf)
    return A.recommend_all(A.fit_als(indexed), users, items)


def als_cv(spark, sf):
    """The grid, tuned on the training part, and the best model's error on the rest."""
    indexed, _, _ = _indexed(spark, sf)
    train, test = R.hash_split(indexed)
    tuned = A.tune_als(train)
    held_out = E.rmse(A.predict_als(tuned.bestModel, test), test).first()["rmse"]
    return A.tuning_report(spark, tuned).withColumn("test_rmse", F.when(F.col("best"), F.lit(held_out)))


def als_user_details(spark, sf):
    """The first user's recommendations with the items' details, best first."""
    indexed, users, items = _indexed(spark, sf)
    user = users.agg(F.min("user_id")).first()[0]
    return A.recommendations_of(A.recommend_for(A.fit_als(indexed), users, items, user), T.item_details(spark, sf), user)


def als_recommend_agrees(spark, sf):
    """Recommendations of the norm-ordered search beside those of the model's own search over all items.

    Per user: whether both have as many items, none twice, and the same ratings at the same ranks.
    """
    indexed, users, items = _indexed(spark, sf)
    model = A.fit_als(indexed)
    mine = A.recommend_all(model, users, items).groupBy("user_id").agg(
        F.sort_array(F.collect_list("rating"), asc=False).alias("mine"), F.countDistinct("item_id").alias("n_items")
    )
    # Blocks by which the model's search merges its lists: by default they are so small that the lists outgrow the disk.
    model.setBlockSize(A.SEARCH_BLOCK)
    own = model.recommendForAllUsers(D.TOP).join(users, "user_index").select("user_id", F.transform("recommendations", lambda r: r["rating"].cast("double")).alias("own"))
    both = mine.join(own, "user_id", "full")
    near = F.forall(F.zip_with("mine", "own", lambda x, y: F.abs(x - y) < 1e-4), lambda same: same)
    agree = near & (F.size("mine") == F.size("own")) & (F.col("n_items") == F.size("mine"))
    return both.agg(
        F.count(F.lit(1)).alias("n_users"), F.sum(F.size("mine")).alias("n_rows"), F.count(F.when(agree, 1)).alias("n_agree")
    )


def als_details_agree(spark, sf):
    """The first user's recommendations with details: their number, different items, whether best first, known names."""
    shown = als_user_details(spark, sf).withColumn("at", F.monotonically_increasing_id())
    listed = shown.agg(F.sort_array(F.collect_list(F.struct("at", "rating"))).alias("rows"), F.countDistinct("item_id").alias("n_items"), F.first("user_id").alias("user_id"), F.collect_list(F.struct("item_id", "name")).alias("named"))
    ratings = F.col("rows.rating")
    named = listed.select(F.explode("named").alias("n")).select("n.item_id", "n.name").join(T.item_details(spark, sf).select("item_id", "name"), ["item_id", "name"])
    return listed.select("user_id", F.size("rows").cast("bigint").alias("n_rows"), "n_items", (F.sort_array(ratings, asc=False) == ratings).alias("best_first"), named.agg(F.count(F.lit(1))).scalar().alias("n_named"))


def als_cv_agrees(spark, sf):
    """A small grid tuned on the training part: its points, the best by the least error, and hold-out pairs it predicts."""
    indexed, _, _ = _indexed(spark, sf)
    train, test = R.hash_split(indexed)
    tuned = A.tune_als(train, ranks=(2, 6), iterations=(2, 4), folds=2)
    report = A.tuning_report(spark, tuned)
    chosen = report.where("best").first()
    predicted = A.predict_als(tuned.bestModel, test)
    least = report.agg(F.min("rmse")).scalar()
    return report.agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("rank", "iterations").alias("n_different"), F.count(F.when(F.col("best") & (F.col("rmse") == least), 1)).alias("n_best"),
        F.lit(chosen["rank"] == tuned.bestModel.rank).alias("best_is_kept"), predicted.agg(F.count(F.lit(1))).scalar().alias("n_predicted"),
    )


def als_reload_agrees(spark, sf):
    """How many hold-out pairs a saved and reloaded model predicts, and for how many it says what the factors say."""
    indexed, _, _ = _indexed(spark, sf)
    train, test = R.hash_split(indexed)
    path = scratch_path(spark, "als-model")
    model = A.fit_als(train)
    model.write().overwrite().save(path)
    of_user = model.userFactors.select(F.col("id").alias("user_index"), F.col("features").alias("u"))
    of_item = model.itemFactors.select(F.col("id").alias("item_index"), F.col("features").alias("i"))
    product = F.aggregate(F.zip_with("u", "i", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda a, x: a + x)
    by_hand = test.join(of_user, "user_index").join(of_item, "item_index").select("user_id", "item_id", product.alias("product"))
    found = A.predict_als(ALSModel.load(path), test).join(by_hand, ["user_id", "item_id"], "full")
    return found.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(F.abs(F.col("stars") - F.col("product")) < 1e-4, 1)).alias("n_agree"))


def text_tfidf(spark, sf):
    """Word weights of the text pipeline with a stopword file, per item, from a saved vocabulary."""
    path = scratch_path(spark, "stopwords")
    _stopwords(spark).select("word").write.text(path)
    stopwords = [r["word"] for r in IO.read_stopwords(spark, path).collect()]
    words = words_of(cleaner(stopwords), T.reviews(spark, sf))
    saved = scratch_path(spark, "word-weights")
    fitted = WordWeights.fit(words)
    fitted.save(saved)
    weights = WordWeights.load(spark, saved).tfidf(counts=fitted.known)
    return weights.select("item_id", "word", F.round("tfidf", 6).alias("tfidf"))


def text_vectors_agree(spark, sf):
    """For how many items the assembled vector is what its parts say: the weighted mean of the words' vectors, and TF-IDF."""
    reviews = T.reviews(spark, sf)
    path = scratch_path(spark, "text-features")
    TextFeatures.fit(reviews, stopwords=STOPWORDS, vector_size=20).save(path)
    features = TextFeatures.load(spark, path)
    words = words_of(features.clean, reviews)
    counts = materialize(WordWeights.counts(words), "item-words")
    of_word = features.model.getVectors().select("word", vector_to_array("vector").alias("v"))
    entry = counts.join(of_word, "word").select("item_id", "n", F.posexplode("v").alias("at", "x"))
    total = counts.groupBy("item_id").agg(F.sum("n").alias("total"))
    mean = entry.groupBy("item_id", "at").agg(F.sum(F.col("n") * F.col("x")).alias("x")).join(total, "item_id")
    mean = mean.select("item_id", "at", (F.col("x") / F.col("total")).alias("x")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))
    weight = features.weights.tfidf(words).groupBy("item_id").agg(F.sum("tfidf").alias("weight"))
    made = vector_entries(features.transform(reviews), "combined_vector", "item_id")
    size = features.weights.size
    tail = F.map_from_entries(F.filter("entries", lambda e: e["index"] >= size))
    numbers = F.transform(F.sequence(F.lit(size), F.lit(size + 19)), lambda j: F.coalesce(F.try_element_at(tail, j), F.lit(0.0)))
    weights = F.aggregate(F.filter("entries", lambda e: e["index"] < size), F.lit(0.0), lambda a, e: a + e["value"])
    made = made.select("item_id", F.col("size").alias("n_features"), numbers.alias("w"), weights.alias("made"))
    both = made.join(mean, "item_id", "left").join(weight, "item_id", "left")
    apart = F.aggregate(F.zip_with("w", F.col("m.x"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    agree = (apart < 1e-6) & (F.abs(F.col("made") - F.col("weight")) <= 1e-9 * F.abs(F.col("weight")) + 1e-9)
    return both.agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(agree, 1)).alias("n_agree"), F.max("n_features").cast("bigint").alias("n_features"))


def text_pipeline_w2v(spark, sf):
    """Item vectors of the fitted text pipeline, after saving and loading it."""
    reviews = T.reviews(spark, sf)
    path = scratch_path(spark, "text-features")
    TextFeatures.fit(reviews).save(path)
    vectors = materialize(TextFeatures.load(spark, path).transform(reviews), "text-vectors")
    sizes = vector_entries(vectors, "combined_vector", "item_id").select("item_id", F.col("size").alias("n_features"))
    return vectors.select("item_id", vector_to_array("word_vector").alias("word_vector")).join(sizes, "item_id")


def content_recommend_w2v(spark, sf):
    """Content recommendations from the word vectors of the review texts."""
    reviews = T.reviews(spark, sf)
    features = TextFeatures.fit(reviews).transform()
    vectors = materialize(features.select("item_id", vector_to_array("word_vector").alias("vector")), "word-vectors")
    return _rank(C.content_recommendations(reviews, vectors))


def hybrid_als(spark, sf):
    """Content recommendations blended with those of a factorisation of the review stars."""
    ratings = materialize(T.review_ratings(spark, sf), "review-ratings")
    indexed, users, items = A.index_ratings(ratings)
    collaborative = A.recommend_all(A.fit_als(materialize(indexed, "indexed-reviews")), users, items)
    return _rank(H.hybrid(content_recommend(spark, sf), collaborative.withColumnRenamed("rating", "score")))


def hybrid_als_agrees(spark, sf):
    """The hybrid list over a factorisation: rows of each source, ranks without gaps, and scores that fall with the rank."""
    listed = materialize(hybrid_als(spark, sf), "hybrid-list")
    of_source = listed.groupBy("user_id", "source").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("rows"), F.countDistinct("item_id").alias("items")
    )
    ranks, scores = F.col("rows.rank"), F.col("rows.score")
    ordered = (ranks == F.sequence(F.lit(1).cast("bigint"), F.size("rows").cast("bigint"))) & (F.sort_array(scores, asc=False) == scores) & (F.col("items") == F.size("rows"))
    return of_source.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_users"), F.sum(F.size("rows")).alias("n_rows"), F.count(F.when(ordered, 1)).alias("n_ordered")
    )


def vector_index_recall(spark, sf):
    """Whether a search of the inverted file for every item finds the wanted share of its nearest, and how many there are."""
    vectors = T.item_vectors(spark, sf)
    exact = similar_items(vectors.select("item_id"), vectors, D.SIMILAR_PER_SEED)
    found = VectorIndex.fit(vectors, D.SIMILAR_PER_SEED).search(vectors, D.SIMILAR_PER_SEED)
    quality = E.recall(found, exact, "seed_id", "item_id")
    return quality.select("n_exact", (F.col("recall") >= D.SEARCH_RECALL).alias("reached"))


def queries() -> dict[str, Query]:
    return {
        "ratings_utility": ratings_utility,
        "user_avg": _average("user_id"),
        "item_avg": _average("item_id"),
        "global_avg": global_avg,
        "rating_counts": rating_counts,
        "baskets_user": _baskets("user_id", "item_id"),
        "baskets_item": _baskets("item_id", "user_id"),
        "users_with_average": users_with_average,
        "liked_items": liked_items,
        "liked_items_sql": liked_items_sql,
        "seed_sample": seed_sample,
        "holdout_split": holdout_split,
        "dense_ids": dense_ids,
        "co_rating_pairs": co_rating_pairs,
        "item_pearson": item_pearson,
        "user_pearson": user_pearson,
        "minhash_signatures": minhash_signatures,
        "lsh_buckets": lsh_buckets,
        "lsh_candidates": lsh_candidates,
        "lsh_verified_jaccard": lsh_verified_jaccard,
        "lsh_user_pearson": lsh_user_pearson,
        "lsh_recall": _lsh_recall("item_id", "user_id"),
        "lsh_user_recall": _lsh_recall("user_id", "item_id"),
        "lsh_sampled_recall": lsh_sampled_recall,
        "lsh_co_raters": lsh_co_raters,
        "lsh_user_pearson_search": lsh_user_pearson_search,
        "lsh_confirmed_recall": lsh_confirmed_recall,
        "item_predict_from_file": item_predict_from_file,
        "item_predict": item_predict,
        "user_predict": user_predict,
        "item_predict_rmse": item_predict_rmse,
        "user_predict_rmse": user_predict_rmse,
        "friends_avg": friends_avg,
        "tokens": tokens,
        "term_counts_without_digits": term_counts_without_digits,
        "term_freq": term_freq,
        "doc_freq_idf": doc_freq_idf,
        "rare_words": rare_words,
        "item_profile_top200": item_profile_top200,
        "item_profile_frequent": item_profile_frequent,
        "user_profile": user_profile,
        "vocab_index": vocab_index,
        "content_scores": content_scores,
        "keyword_search": keyword_search,
        "keyword_index_search": keyword_index_search,
        "vector_cosine_topn": vector_cosine_topn,
        "content_recommend": content_recommend,
        "item_details": item_details,
        "hybrid_union": hybrid_union,
        "reviews_json": reviews_json,
        "average_map_file": average_map_file,
        "similarity_model_file": similarity_model_file,
        "predictions_file": predictions_file,
        "profile_file": profile_file,
        "profiles_parquet": profiles_parquet,
        "als_holdout": als_holdout,
        "als_recommend": als_recommend,
        "als_cv": als_cv,
        "als_user_details": als_user_details,
        "als_reload_agrees": als_reload_agrees,
        "als_recommend_agrees": als_recommend_agrees,
        "als_details_agree": als_details_agree,
        "als_cv_agrees": als_cv_agrees,
        "text_vectors_agree": text_vectors_agree,
        "hybrid_als_agrees": hybrid_als_agrees,
        "vector_index_recall": vector_index_recall,
        "text_tfidf": text_tfidf,
        "text_pipeline_w2v": text_pipeline_w2v,
        "content_recommend_w2v": content_recommend_w2v,
        "hybrid_als": hybrid_als,
    }
