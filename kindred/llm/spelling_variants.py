"""Spelling variants: words at one edit from a much more frequent word, by dynamic programming over sorted lists.

Two words of n and m >= n code points that are one edit apart share at least m - 1 code points at their ends: half of
them as a prefix or half as a suffix. Every word therefore stands in two lists of words of its length, that of its
first half and that of its last half, and asks them and the two lists of the next shorter length. Shared ends are cut
off, and the middles of a list, which have one length, are sorted.

A list is scanned along its shared prefixes. Adjacent middles and the length of their common prefix (LCP) give, at each depth,
the ranges of the list that share so many code points. The banded row of the edit matrix (three cells, as one edit
leaves the diagonal by one) of a query is computed once for a range and reused for every word in it; a range whose row has no cell
below two is skipped with all its words. All queries of many lists move down one code point at a time together.

A list of too many code points is cut again by the halves of its middles, until it is small enough or its middles have one code
point, of which there are few. So no frequent beginning or ending gathers in one task, and no pair is lost or
found twice: lists by suffix report only pairs whose common prefix was too short for the list by prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import CRC_TABLE, crc32_sql, materialize, table

#: Upper-case letters, and what separates words after they are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[^a-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Code points of a list's middles from which it is cut again, and rows and code points that a task handles at a time.
LIST_CELLS = 1 << 18
CHUNK_ROWS = 1 << 15
CHUNK_CELLS = 1 << 20
#: A number no distance reaches.
FAR = 9

#: What words of one list have in common: length, prefix, suffix, and the length that a pair's common prefix stays below.
LIST = ("length", "prefix", "suffix", "below")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with their counts over all texts.

    Where 97 divides the crc32 h of ``<doc_id>:<run>``, the run loses its code point h % length. A null id counts as
    the empty text there. Words have at least five code points and three occurrences; null and empty texts have none.
    """
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower, SEPARATOR)).alias("run"))
    runs = runs.where(F.length("run") >= MIN_LENGTH).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def lists(words: DataFrame) -> DataFrame:
    """(LIST..., middle, word, n) of each word in the lists by prefix and by suffix of its own and the next shorter length."""
    place = F.array(*[F.struct((F.length("word") - k).alias("length"), F.lit(side).alias("side")) for k in (0, 1) for side in (0, 1)])
    placed = words.select("word", "n", F.inline(place)).withColumn("half", F.floor(F.col("length") / 2).cast("int"))
    return halved(placed.withColumns({"prefix": F.lit(""), "suffix": F.lit(""), "middle": F.col("word"), "below": F.lit(1 << 30)}))


def halved(rows: DataFrame) -> DataFrame:
    """Rows (LIST..., middle, word, n, side, half), with half of the middle moved to the prefix or the suffix."""
    first, size = F.col("side") == 0, F.length("middle")
    half, none = F.col("half"), F.lit("")
    return rows.select(
        "length",
        F.concat("prefix", F.when(first, F.substring("middle", F.lit(1), half)).otherwise(none)).alias("prefix"),
        F.concat(F.when(first, none).otherwise(F.substring("middle", size - half + 1, half)), "suffix").alias("suffix"),
        F.when(first, F.col("below")).otherwise(F.least("below", F.length("prefix") + half)).alias("below"),
        F.when(first, F.substring("middle", half + 1, size)).otherwise(F.substring("middle", F.lit(1), size - half)).alias("middle"),
        "word", "n",
    )


def bounded_lists(rows: DataFrame, cells: int = LIST_CELLS) -> DataFrame:
    """The same lists, those of more than ``cells`` code points cut again by the halves of their middles."""
    done = None
    size = F.col("length") - F.length("prefix") - F.length("suffix")  # code points of the list's own middles
    while True:
        large = rows.where(size > 1).groupBy(*LIST).agg(F.sum(F.greatest(F.length("middle"), F.lit(1))).alias("cells")).where(F.col("cells") > cells)
        large = materialize(large.select(*LIST, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")), "large-lists")
        if not large.head(1):
            return rows if done is None else done.unionByName(rows)
        # The rows of a large list meet its mark in 16 places.
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(16)).cast("int"))
        part = materialize(rows.join(large.withColumn("cut", F.lit(True)).hint("merge"), [*LIST, "salt"], "left").drop("salt"), "lists")
        kept = part.where("cut is null").drop("cut")
        done = kept if done is None else done.unionByName(kept)
        again = part.where("cut").drop("cut").withColumn("half", F.floor(size / 2).cast("int"))
        rows = halved(again.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))))


def code_points(texts: list[str], width: int) -> np.ndarray:
    """One row per text, padded with zeros."""
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(texts), width)


def scan(group: np.ndarray, middles: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) at exactly one edit among the rows of sorted lists.

    ``group`` numbers the list of each row, ``own`` is the length of its list's middles. Rows whose own middle has that length are
    listed; all rows ask, those of the list for rows after them only. Rows are sorted by list and middle.
    """
    length = np.fromiter(map(len, middles), np.int64, len(middles))
    width = int(length.max(initial=0)) + 2
    codes = code_points(middles, width)
    listed = np.flatnonzero(length == own)
    if not len(listed):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, of = codes[listed], group[listed]
    # LCP with the listed row before; -1 where a list begins.
    differs = rows[1:] != rows[:-1]
    lcp = np.concatenate(([-1], np.where(of[1:] == of[:-1], np.where(differs.any(1), differs.argmax(1), width), -1)))
    query = np.arange(len(middles))
    low, high = np.searchsorted(of, group, "left"), np.searchsorted(of, group, "right")
    some = high > low
    query, low, high = query[some], low[some], high[some]
    b0, b1, b2 = (np.full(len(query), v, np.uint8) for v in (FAR, 0, 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(width):
        ends = own[query] == depth
        if ends.any():
            # The distance stands in the cell of the query's last code point, one further for longer queries.
            last = np.where(length[query[ends]] > depth, b2[ends], b1[ends])
            near = last == 1
            q, first, until = query[ends][near], low[ends][near], high[ends][near]
            times = until - first
            rows_at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            found.append((np.repeat(q, times), listed[rows_at]))
            query, low, high, b0, b1, b2 = (x[~ends] for x in (query, low, high, b0, b1, b2))
        if not len(query):
            break
        starts = np.flatnonzero(lcp <= depth)  # where a range that shares one code point more begins
        first, until = np.searchsorted(starts, low), np.searchsorted(starts, high)
        times = until - first
        child = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        stop = np.append(starts, len(listed))
        query, b0, b1, b2 = (np.repeat(x, times) for x in (query, b0, b1, b2))
        low, high = stop[child], stop[child + 1]
        code = rows[low, depth]
        n0 = np.minimum(b0 + (code != codes[query, max(depth - 1, 0)]), b1 + 1)
        n1 = np.minimum(np.minimum(b1 + (code != codes[query, depth]), b2 + 1), n0 + 1)
        n2 = np.minimum(b2 + (code != codes[query, min(depth + 1, width - 1)]), n1 + 1)
        alive = np.minimum(np.minimum(n0, n1), n2) <= 1
        query, low, high = query[alive], low[alive], high[alive]
        b0, b1, b2 = (np.minimum(x[alive], FAR).astype(np.uint8) for x in (n0, n1, n2))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    asked, answer = (np.concatenate(x) for x in zip(*found, strict=True))
    once = (length[asked] > own[asked]) | (asked < answer)
    return asked[once], answer[once]


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, n, near_n) for both words of each pair, of rows (LIST..., middle, word, n) sorted by list and middle."""
    waiting: list[tuple] = []
    cells = 0

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        number, last, group = -1, None, np.empty(len(rows), np.int64)
        for i, r in enumerate(rows):
            if r[:4] != last:
                number, last = number + 1, r[:4]
            group[i] = number
        own = np.array([r[0] - len(r[1]) - len(r[2]) for r in rows], np.int64)
        asked, found = scan(group, [r[4] for r in rows], own)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for q, f in zip(asked.tolist(), found.tolist(), strict=True):
            (_, prefix, _, below, _, a, n_a), (*_, b, n_b) = rows[q], rows[f]
            if below <= len(b) and a[:below] == b[:below]:
                continue  # the list by prefix has this pair
            for column, x, y in zip(out, (a, b, n_a, n_b), (b, a, n_b, n_a), strict=True):
                column.extend((x, y))
        for low in range(0, len(out[0]), 1 << 16):
            part = [c[low : low + (1 << 16)] for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64())], names=["word", "near", "n", "near_n"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            # A chunk ends where a list ends, or where middles become much longer, as rows are padded.
            if waiting and row[:4] != waiting[-1][:4] and (len(waiting) >= CHUNK_ROWS or cells >= CHUNK_CELLS or row[0] > 2 * waiting[0][0]):
                yield from answer(waiting)
                waiting, cells = [], 0
            waiting.append(row)
            cells += len(row[4])
    if waiting:
        yield from answer(waiting)


def neighbours(words: DataFrame, cells: int = LIST_CELLS) -> DataFrame:
    """(word, near, n, near_n): each pair of words (word, n) at exactly one edit, in both directions."""
    rows = bounded_lists(lists(words), cells)
    dealt = rows.repartition(*LIST).sortWithinPartitions(*LIST, "middle", "word")
    return dealt.select(*LIST, "middle", "word", "n").mapInArrow(near_pairs, "word string, near string, n long, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last form on the way from each word; a word that has no row is an end.

    Each round doubles the length of all steps that have not come to an end. Counts at least double from word to form, so a
    way has at most as many steps as the largest count has bits. Steps at their end, which may share a frequent root, are
    looked up by others and stay out of the joins themselves.
    """
    onward = forms.select(F.col("word").alias("at"))
    steps = forms.select("word", F.col("form").alias("to")).join(onward.hint("merge"), F.col("to") == F.col("at"), "left")
    steps = materialize(steps.select("word", "to", F.col("at").isNotNull().alias("open")), "steps")
    while steps.where("open").head(1):
        further = steps.select(F.col("word").alias("at"), F.col("to").alias("next"), F.col("open").alias("still"))
        moved = steps.where("open").select("word", "to").join(further.hint("merge"), F.col("to") == F.col("at"))
        steps = materialize(steps.where("not open").unionByName(moved.select("word", F.col("next").alias("to"), F.col("still").alias("open"))), "steps")
    return steps.select("word", F.col("to").alias("root"))


def group_variants(words: DataFrame, times: int = TIMES, cells: int = LIST_CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
    the largest count (ties: the smallest in code-point order) if that is at least ``times`` its own, else null. ``root`` is
    reached by following forms. Words must differ and not be null; no words give no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = neighbours(words, cells).groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rarer"), "near")).alias("best")
    )
    enough = -F.col("best.rarer") >= times * F.col("n")

    def if_enough(column: Column) -> Column:
        return F.when(enough, column)

    found = materialize(near.select("word", "n_near", if_enough(F.col("best.near")).alias("form"), if_enough(-F.col("best.rarer")).alias("form_n")), "near")
    ends = roots(found.where("form is not null")).withColumnRenamed("word", "of_root")
    known = found.withColumnRenamed("word", "of")
    joined = words.join(known.hint("merge"), F.col("word") == F.col("of"), "left").join(ends.hint("merge"), F.col("word") == F.col("of_root"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return group_variants(vocabulary(table(spark, sf_dir, "documents")))


ORACLE = rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS steps),
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY id, run
), hashed AS (
  SELECT run, times, {crc32_sql("id || ':' || run", "steps")} AS h FROM runs, crc
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cuts AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
  SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best WHERE place = 1
), way AS (
  SELECT word, word AS at FROM words UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.at AS root FROM way w LEFT JOIN forms f ON f.word = w.at WHERE f.form IS NULL
)
SELECT w.word, f.form, e.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM words w JOIN ends e ON e.word = w.word LEFT JOIN forms f ON f.word = w.word
"""
