"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Every row starts in one group. Each level reads the next digit of each row's bytes, splits every group by that
digit, and sends on only the groups that still have two rows or more and bytes left. A group that is a singleton
is unique; a group whose rows end together is a class of equal texts. Equality is decided by the bytes alone, no
digest takes part.

A digit is a string of bytes, and levels widen it (64, 512, 4096, ... bytes), so that texts of n bytes are told
apart in log n levels and no byte crosses the network as part of a digit more than once. Rows of one group are
never gathered: a digit's rows are counted with partial aggregates, and only the counted digits, one row each,
are joined back to the rows. A group that holds a third of all rows is split over tasks by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import SPACE, keep_rows, materialize, table, text_hash
from kindred.operators.pairs import attach

#: Bytes of the first digit, and how much longer each level's digit is.
FIRST_DIGIT = 64
WIDENING = 8


def normalised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_points, text_sha256, tail): the length of the text, and its bytes without white space."""
    raw = F.coalesce(F.col(text), F.lit(""))
    bare = docs.select(
        F.col(doc_id).alias("doc_id"), text_hash(text).alias("text_hash"), F.length(raw).alias("n_points"), F.regexp_replace(raw, SPACE + "+", "").alias("bare")
    )
    return bare.select(
        "doc_id", "text_hash", "n_points", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), F.col("bare").cast("binary").alias("tail")
    )


def equality_classes(rows: DataFrame, first_digit: int = FIRST_DIGIT, widening: int = WIDENING) -> DataFrame:
    """Adds ``class_id`` (null for a unique row) and ``row_id`` to rows with a binary column ``tail``.

    ``tail`` must not be null; it does not come back. Rows keep their other columns and may repeat.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != "tail"]
    active = rows.withColumn("group_id", F.lit(0).cast("long"))
    width, done = first_digit, []
    while True:
        digits = active.withColumns(
            {"digit": F.substring("tail", 1, width), "ended": F.length("tail") <= width}
        )
        groups = materialize(
            digits.groupBy("group_id", "digit", "ended")
            .count()
            .where("count > 1")
            .select(
                F.col("group_id").alias("g"), F.col("digit").alias("d"), F.col("ended").alias("e"),
                F.monotonically_increasing_id().alias("next_id"),
            ),
            "radix-groups",
        )
        same = (F.col("group_id") == F.col("g")) & (F.col("digit") == F.col("d")) & (F.col("ended") == F.col("e"))
        split = digits.join(groups.hint("merge"), same, "left").select(
            *[F.col(c) for c in kept],
            *([] if "row_id" in kept else [F.monotonically_increasing_id().alias("row_id")]),
            F.when(F.col("ended"), F.col("next_id")).alias("ended_id"),
            F.when(~F.col("ended"), F.col("next_id")).alias("group_id"),
            F.when(~F.col("ended") & F.col("next_id").isNotNull(), F.expr(f"substring(tail, {width + 1}, length(tail))")).alias("tail"),
        )
        split = materialize(split, "radix-level")
        kept = [c for c in kept if c != "row_id"] + ["row_id"]
        level = len(done)
        done.append(
            split.where("group_id is null").select(
                *kept,
                F.when(F.col("ended_id").isNotNull(), F.struct(F.lit(level).alias("level"), F.col("ended_id").alias("id"))).alias("class_id"),
            )
        )
        if not groups.where(~F.col("e")).head(1):
            break
        active = split.where("group_id is not null").select(*kept, "tail", "group_id")
        width *= widening
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they are identical without white space; a null text counts as empty, and empty texts are
    equal to each other. The row with the most code points in its original text stays, then the one with the
    smallest doc_id; a null doc_id comes last, and of fully repeated rows any one stays. Extra columns of ``docs``
    are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = equality_classes(normalised(docs, doc_id, text))
    # The smallest struct wins: longest text, then smallest id with nulls last, then row_id among repeated rows.
    order = F.struct(
        (-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("keep_id"), "row_id"
    )
    classes = materialize(rows.where("class_id is not null").groupBy("class_id").agg(F.min(order).alias("best"), F.count("*").alias("size")), "classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    # Unique rows, which have no class, stay out of the join, where as nulls they would all meet in one task; and what is
    # known of large classes goes to their rows, not the rows to one task.
    unique = rows.where("class_id is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "text_hash"
    )
    members = attach(rows.where("class_id is not null"), classes, "class_id", "size", total).select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
        "text_hash",
    )
    return unique.unionByName(members)


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts."""
    return keep_rows(docs, deduplicate(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    return deduplicate(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS n
  FROM bare WINDOW w AS (PARTITION BY bare ORDER BY n_points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, n AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM ranked
"""
