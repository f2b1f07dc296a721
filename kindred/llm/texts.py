"""What the operators share: reading tables, the word class, and written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.session import materialize

__all__ = ["CRC_TABLE", "DOCUMENT", "SPACE", "WORD", "crc32_sql", "held_out", "keep_rows", "materialize", "text_hash", "table", "text_or_empty", "words"]

#: Columns of the table ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: The six ASCII white-space characters, and a run of anything else. Java's regular expressions know both.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: DuckDB SQL of the 256 remainders that a byte-wise crc32 looks up, from its polynomial.
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END))"


def crc32_sql(text: str, steps: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes; ``steps`` is a column that holds ``CRC_TABLE``."""
    code = f"hex({text})"
    byte = f"list_transform(range(0, length({code}), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr({code}, i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr({code}, i + 2, 1)) - 1)"
    return f"xor(list_reduce([4294967295] || {byte}, lambda c, b: xor(c // 256, {steps}[xor(c, b) % 256 + 1])), 4294967295)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_hash, kept; one row per row of ``docs``) keeps.

    Rows are known by id and text. Of rows alike in both, as many stay as are kept. All columns stay, whatever their
    names. Only ids and hashes are grouped; each text is shuffled once, to meet the decision on it.
    """
    keys = decided.groupBy("doc_id", "text_hash").agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("rows"))
    keys = materialize(keys.where("stay < rows"), "decisions").select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "stay")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", text_hash().alias("hash"))
    joined = whole.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    untouched = joined.where("stay is null").select("whole.*")
    if not keys.where("stay > 0").head(1):
        return untouched
    alike = Window.partitionBy("doc_id", "hash").orderBy("hash")
    some = joined.where("stay > 0").withColumn("place", F.row_number().over(alike)).where("place <= stay")
    return untouched.unionByName(some.select("whole.*"))
