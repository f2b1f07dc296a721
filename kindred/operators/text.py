"""Words of reviews, their weights, and the word profiles of items and users."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.defaults import MIN_LENGTH, PROFILE_WORDS, RARE_SHARE
from kindred.functions.words import is_number, split_words, strip_digits, strip_punctuation
from kindred.operators.ids import dense_index
from kindred.operators.ranking import top_k
from kindred.session import materialize, spread


def stopword_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def tokenize(
    rows: DataFrame,
    stopwords: DataFrame | None = None,
    text: str = "text",
    keep: tuple[str, ...] = ("user_id", "item_id"),
    min_length: int = MIN_LENGTH,
    remove_digits: bool = False,
) -> DataFrame:
    """One row per kept word of each text: ``(*keep, word)``, from the whole text.

    Texts are never concatenated: counting words per item needs no document of all its reviews.
    """
    cleaned = strip_punctuation(F.col(text))
    if remove_digits:
        cleaned = strip_digits(cleaned)
    words = spread(rows.select(*keep, text)).select(*keep, F.explode(split_words(cleaned)).alias("word"))
    words = words.where((F.length("word") >= min_length) & ~is_number(F.col("word")))
    if stopwords is not None:
        words = words.join(stopwords.select("word").distinct(), "word", "left_anti").select(*keep, "word")
    return words


def term_counts(tokens: DataFrame) -> DataFrame:
    """``(item_id, word, n)``."""
    return tokens.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("n"))


def word_totals(counts: DataFrame) -> DataFrame:
    """``(word, n)`` over all items."""
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def rare_words(counts: DataFrame, share: float = RARE_SHARE) -> DataFrame:
    """Words that make up less than ``share`` of all words: ``(word, n)``."""
    totals = word_totals(counts)
    everything = counts.agg(F.sum("n")).scalar()
    return totals.where(F.col("n") < F.lit(share) * everything)


def without_rare(counts: DataFrame, share: float = RARE_SHARE) -> DataFrame:
    return counts.join(rare_words(counts, share).select("word"), "word", "left_anti").select("item_id", "word", "n")


def term_frequencies(counts: DataFrame) -> DataFrame:
    """``(item_id, word, n, tf)`` with tf = n / all words of the item."""
    totals = counts.groupBy("item_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "item_id").select("item_id", "word", "n", (F.col("n") / F.col("total")).alias("tf"))


def inverse_frequencies(counts: DataFrame, n_items: Column) -> DataFrame:
    """``(word, df, idf)`` with idf = log2(items / items that have the word)."""
    return (
        counts.groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
        .select("word", "df", F.log2(n_items / F.col("df")).alias("idf"))
    )


def item_count(reviews: DataFrame) -> Column:
    """Number of reviewed items, as a scalar subquery."""
    return reviews.agg(F.countDistinct("item_id")).scalar()


def item_profiles(
    reviews: DataFrame,
    stopwords: DataFrame | None = None,
    words: int = PROFILE_WORDS,
    rare_share: float | None = None,
) -> DataFrame:
    """The ``words`` words of highest TF-IDF of each item: ``(item_id, word, tfidf, rank)``.

    The word counts are written once; totals, document frequencies and scores read that table instead
    of tokenising the texts again.
    """
    counts = term_counts(tokenize(reviews, keep=("item_id",)))
    if stopwords is not None:
        # A word is looked up once per item, not at each occurrence; stopwords make few of the counts.
        counts = counts.join(stopwords.select("word").distinct(), "word", "left_anti").select("item_id", "word", "n")
    counts = materialize(counts, "term-counts")
    idf = inverse_frequencies(counts, item_count(reviews)).select("word", "idf")
    if rare_share is not None:
        # A word is rare or not for all items, so leaving it out changes no other word's idf: one join does both.
        idf = idf.join(rare_words(counts, rare_share).select("word"), "word", "left_anti")
        counts = counts.join(idf.hint("shuffle_hash"), "word")
        counts = materialize(counts.select("item_id", "word", "n", "idf"), "frequent-words")
    # Written, so that its size is known when the join is planned: few items then come to where the words are, and only the
    # best words of each are shuffled.
    totals = materialize(counts.groupBy("item_id").agg(F.sum("n").alias("total")), "item-totals")
    if rare_share is None:
        # One row per word, of which a task holds its share: hashed, neither side has to be sorted.
        counts = counts.join(idf.hint("shuffle_hash"), "word")
    # By word first, by item last: the ranking then needs no further shuffle.
    scored = counts.join(totals, "item_id").select("item_id", "word", F.round(F.col("n") / F.col("total") * F.col("idf"), 9).alias("tfidf"))
    return top_k(scored, ["item_id"], [F.desc("tfidf"), F.col("word")], words)


def user_profiles(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(user_id, word)``: the words of every item the user reviewed."""
    visited = reviews.select("user_id", "item_id").distinct()
    return visited.join(profiles.select("item_id", "word"), "item_id").select("user_id", "word").distinct()


def vocabulary(profiles: DataFrame) -> DataFrame:
    """``(word, index)``: the profile words in alphabetical order, numbered from 0."""
    return dense_index(profiles, "word")
