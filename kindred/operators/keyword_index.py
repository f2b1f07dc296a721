"""An inverted index of profile words: a search reads the postings of its words, not the profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.scores import set_cosine
from kindred.operators.pairs import attach
from kindred.operators.ranking import best
from kindred.operators.text import tokenize
from kindred.session import materialize

# Folders that postings are dealt over by their word, and postings of one file at most.
BUCKETS = 256
FILE_ROWS = 5_000_000


class KeywordIndex:
    """Postings ``(word, item_id, n_item)`` in folders by word; ``n_item`` is the number of the item's words.

    A word's postings lie in one folder, sorted by word, so that a search opens as many folders as it has words and
    skips the rows of others by the files' statistics. Frequent words are several files of their folder.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str, buckets: int = BUCKETS):
        self.spark, self.path, self.id_type, self.buckets = spark, path, id_type, buckets

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"word string, item_id {self.id_type}, n_item bigint, bucket int").parquet(self.path)

    @classmethod
    def build(cls, item_words: DataFrame, path: str, buckets: int = BUCKETS, file_rows: int = FILE_ROWS) -> KeywordIndex:
        """From ``(item_id, word)`` without repeats."""
        rows = item_words.select("item_id", "word")
        sizes = materialize(rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item")), "item-sizes")
        total = sizes.agg(F.sum("n_item")).first()[0] or 0
        listed = attach(rows, sizes, "item_id", "n_item", total).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
        # Files of a bucket hold about as many rows as allowed; which of them a posting is in follows from its item.
        parts = max(1, total // (buckets * file_rows))
        dealt = listed.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).repartition("bucket", "part").sortWithinPartitions("bucket", "word")
        dealt.select("word", "item_id", "n_item", "bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        return cls(item_words.sparkSession, path, dict(item_words.dtypes)["item_id"], buckets)

    def postings_of(self, words: list[str]) -> DataFrame:
        """The postings of some words; only their folders are listed and read."""
        frame = self.spark.createDataFrame([(w,) for w in words], "word string")
        buckets = [r[0] for r in frame.select(F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("word").isin(words))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Items whose words match a query text best: ``(item_id, n_matched, score)``, as ``content.keyword_search`` finds them."""
        text = self.spark.createDataFrame([(query,)], "text string")
        asked = sorted(r["word"] for r in tokenize(text, keep=()).distinct().collect())  # the words of one query
        found = self.postings_of(asked).groupBy("item_id", "n_item").agg(F.count(F.lit(1)).alias("n_matched"))
        score = F.round(set_cosine(F.col("n_matched"), F.col("n_item"), F.lit(len(asked))), 6).alias("score")
        return best(found.select("item_id", "n_matched", score), [F.desc("score"), F.col("item_id")], limit)
