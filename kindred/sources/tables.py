"""Typed readers and distributed writers of entity, model and prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.hashing import mix, numeric_id
from kindred.operators.ratings import baskets


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema, so that no pass over the data is spent on inference."""
    df = spark.read.schema(schema).json(path)
    return df.withColumnRenamed("business_id", "item_id")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, written by the executors."""
    df.withColumnRenamed("item_id", "business_id").write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# An entry of a map: a string with its escapes, a colon and a number; and how an entry ends. A quote with an odd number
# of backslashes before it belongs to the string.
_NUMBER = r"(?:-?[0-9][0-9.eE+-]*|null)"
ENTRY = rf'^\s*\{{?\s*"(?:[^"\\]|\\.)*+"\s*:\s*{_NUMBER}\s*\}}?\s*$'
ENTRY_END = rf'(?<!\\)(?:\\\\)*"\s*:\s*{_NUMBER}\s*\}}?\s*$'


def read_average_map(spark: SparkSession, path: str, key: str, name: str = "average_stars") -> DataFrame:
    """``(key, name)`` from files of maps of id to average, in any number of lines; null averages are left out.

    A map may be one line of any length: the reader splits at commas, so the line is read by as many tasks as its bytes
    need. Nearly all parts are whole entries. Ids with commas come in several parts, which are put together again in
    the order of the file, within a split of it first and then over the splits' borders.
    """
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # No string of JSON has a raw line feed, so lines are apart wherever one is.
    parts = raw.select("file", "block", F.monotonically_increasing_id().alias("at"), F.posexplode(F.split("value", "\n")).alias("line", "part"))
    whole = parts.where(F.col("part").rlike(ENTRY)).select(F.col("part").alias("entry"))
    # Splits of one file may be read in any order, so the block comes first; ids of a task rise as it reads.
    order = ["at", "line"]
    open_parts = parts.where(~F.col("part").rlike(ENTRY) & ~F.col("part").rlike(r"^[\s{}]*$")).withColumn("ends", F.col("part").rlike(ENTRY_END).cast("int"))
    in_block = Window.partitionBy("file", "block").orderBy(*order)
    runs = open_parts.withColumn("run", F.coalesce(F.sum("ends").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = runs.groupBy("file", "block", "run").agg(
        F.sort_array(F.collect_list(F.struct("at", "line", "part"))).alias("parts"), F.max("ends").alias("ends")
    ).select("file", "block", "run", "ends", F.array_join("parts.part", ",").alias("piece"))
    # A split's last run may go on in the first of the next: pieces up to one that ends are an entry.
    in_file = Window.partitionBy("file").orderBy("block", "run")
    border = pieces.where((F.col("run") == 0) | (F.col("ends") == 0))
    joined = border.withColumn("entry_no", F.coalesce(F.sum("ends").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = joined.groupBy("file", "entry_no").agg(F.sort_array(F.collect_list(F.struct("block", "run", "piece"))).alias("pieces")).select(F.array_join("pieces.piece", ",").alias("entry"))
    inner = pieces.where((F.col("run") > 0) & (F.col("ends") == 1)).select(F.col("piece").alias("entry"))
    bare = F.regexp_replace(F.regexp_replace("entry", r"^\s*\{", ""), r"\}\s*$", "")
    entries = whole.unionByName(joined).unionByName(inner).select(F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), "map<string,double>").alias("map"))
    return entries.select(F.explode("map").alias(key, name)).where(F.col(name).isNotNull())


def write_average_map(averages: DataFrame, key: str, value: str, path: str, per_line: int = 10_000) -> None:
    """Maps of id to average, about ``per_line`` entries to a line.

    Few entries make one line; more make more lines, since one line is one row in one task.
    """
    number = numeric_id(F.col(key), dict(averages.dtypes)[key])
    lines = F.greatest(F.ceil(averages.agg(F.count(F.lit(1))).scalar() / per_line), F.lit(1))
    entries = F.collect_list(F.struct(F.col(key).cast("string"), F.col(value)))
    grouped = averages.groupBy((mix(number, F.lit(0)) % lines).alias("line")).agg(F.map_from_entries(entries).alias("averages"))
    grouped.select(F.to_json("averages").alias("value")).write.mode("overwrite").text(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``, one per line; trailing whitespace is not part of the word."""
    return spark.read.text(path).select(F.rtrim("value").alias("word"))


def write_profiles(profiles: DataFrame, key: str, member: str, path: str) -> None:
    """Lines ``{id: [members]}``; a long list is spread over several lines of the same id."""
    listed = baskets(profiles, key, member)
    line = F.to_json(F.create_map(F.col(key).cast("string"), "members"))
    listed.select(line.alias("value")).write.mode("overwrite").text(path)


def read_profiles(spark: SparkSession, path: str, key: str, member: str) -> DataFrame:
    """``(key, member)`` rows from lines ``{id: [members]}``."""
    entry = F.from_json("value", "map<string,array<string>>")
    lists = spark.read.text(path).select(F.explode(entry).alias(key, "members"))
    return lists.select(key, F.explode("members").alias(member))


def register_views(**tables: DataFrame) -> None:
    """Make tables available to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
