"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A signature of m values gives each element of a set a random permutation of the m positions; at its j-th place the
element offers j plus a fraction, and a position keeps its least offer. An element's ranks are thus correlated over
the positions, which lowers the variance of the similarity estimate. Step j only has offers in [j, j + 1), so once every
position has an offer no later step can change any: large sets stop after a few steps.

Sets that are equal collapse to one representative before anything else. Bands of the representatives' signatures
find candidates. A bucket is not opened into pairs: its member with the most company, the centre, is compared with all
others, links are confirmed on the full sets, and linked members fall into one component. So a group of many near
copies costs about one comparison a member. What is left are pairs of a bucket in different components. Those of small
buckets are compared. In larger ones, what is known of each member, how many elements it shares with the centre c,
bounds what two members share: |a & b| <= min(|a & c|, |b & c|) + the elements outside c that both have. Pairs that
can reach the similarity without such elements are found by their sizes; all others have such elements in common, and
among the rarest of their group (a prefix filter finds them). Both are exact: no link within a bucket is lost, and a
bucket's pairs are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.texts import keep_rows, materialize, table, text_hash
from kindred.operators.pairs import attach, pairs_within

#: Bands and rows: a pair of similarity 0.8 shares no band with a probability of 3e-6.
BANDS = 42
ROWS = 6
SIMILARITY = 80
#: Words of a shingle where no contract says otherwise.
SHINGLE_WORDS = 5
#: Members of a bucket up to which all its pairs in different components are compared.
SMALL_BUCKET = 16
#: Elements of a set, and texts, handled at a time within a task.
BLOCK = 4096
CHUNK = 256

_U = np.uint64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        return np.cumprod(np.concatenate(([_U(1)], np.full(n, base, dtype=_U))), dtype=_U)

    return up(_BASE), up(_INVERSE)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased.

    Fewer words than ``width`` make one shingle, no words none. Word hashes are polynomials over the bytes, taken
    for all words at once from prefix sums modulo 2^64.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    n = len(first)
    if not n:
        return np.empty(0, dtype=_U)
    up, down = _powers(1 << int(len(data)).bit_length())
    prefix = np.concatenate(([_U(0)], np.cumsum(mix(data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)))
    word = mix((prefix[last] - prefix[first]) * down[first] + (last - first).astype(_U) * _U(_BASE))
    k = min(width, n)
    gram = word[: n - k + 1]
    for j in range(1, k):
        gram = mix(gram * _U(3) + word[j : n - k + 1 + j])
    if n < width:
        gram = mix(gram + _U(n))
    return np.unique(gram)


def signature(elements: np.ndarray, m: int) -> np.ndarray:
    """The m values of the set's signature: place in the upper 32 bits, fraction in the lower."""
    least = np.full(m, np.iinfo(np.uint64).max, dtype=_U)
    for low in range(0, len(elements), BLOCK):
        block = elements[low : low + BLOCK]
        rows = np.arange(len(block))
        order = np.tile(np.arange(m, dtype=np.uint16), (len(block), 1))
        for j in range(m):
            bits = mix(block + _U((j + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
            k = j + (((bits & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
            at = order[rows, k]
            order[rows, k] = order[:, j]
            np.minimum.at(least, at, _U(j << 32) | (bits >> _U(32)))
            if least.max() < _U((j + 1) << 32):
                break
    return least


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of the signature; bands of different places never share keys on purpose."""
    by_band = values.reshape(-1, rows)
    key = mix(np.arange(1, len(by_band) + 1, dtype=_U) * _U(_BASE))
    for r in range(rows):
        key = mix(key ^ by_band[:, r])
    return key.view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK):
            yield batch.slice(low, CHUNK)


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, keys of (doc_id, text, text_hash); the last two null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            size, digest, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(signature(found, bands * rows), rows) if len(found) else None)
            columns = [
                batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_key", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, keys array<long>")


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """node and elements (sorted hashes of all shingles) of rows (node, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(text, width).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "elements"])

    return rows.mapInArrow(build, "node long, elements array<long>")


def could_link(n_a: str, n_b: str, similarity: int) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return 100 * F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)


def enough(shared: Column, n_a: str, n_b: str, similarity: int) -> Column:
    """Whether 100 * intersection >= similarity * union if ``shared`` elements are common to sets of these sizes."""
    return (100 + similarity) * shared >= similarity * (F.col(n_a) + F.col(n_b))


def compared(pairs: DataFrame, sets: DataFrame, *extra: Column) -> DataFrame:
    """Pairs (a, b, ...) with ``common``, the size of their full sets' intersection, and columns of ``of_a`` and ``of_b``."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select(*pairs.columns, F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("common"), *extra)


def around_centres(group: DataFrame, similarity: int) -> DataFrame:
    """Pairs of a group around a centre that may be similar enough: a, n_a, b, n_b.

    ``group`` has centre, node, n, root, common (elements shared with the centre), linked (to the centre) and outside
    (the node's other elements). Pairs of one root are left out.
    """
    # Without shared elements outside the centre, the elements inside must do. One of the two is not linked to the
    # centre and falls short for the centre's size, so only smaller partners come into question.
    least = F.ceil(F.col("n") * similarity / 100)
    most = F.floor(F.col("common") * (100 + similarity) / similarity) - F.col("n")
    loose = group.where(~F.col("linked") & (least <= most)).select(
        F.col("centre").alias("c"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.explode(F.sequence(least, most)).alias("n_b")
    )
    partner = group.select("centre", F.col("node").alias("b"), F.col("n").alias("own_n"), F.col("root").alias("root_b"), F.col("common").alias("k_b"))
    inside = loose.join(
        partner.hint("merge"),
        (F.col("c") == F.col("centre")) & (F.col("n_b") == F.col("own_n")) & (F.col("root_a") != F.col("root_b")) & enough(F.col("k_b"), "n_a", "n_b", similarity),
    ).select("a", "n_a", "b", "n_b")
    # All others share elements outside the centre. If two sets of s and l elements, s <= l, are similar enough, they
    # share at least 2 similarity / (100 + similarity) * s and at least similarity / 100 * l; what the inside cannot
    # give of that, the outside must, so one of the rarest remaining elements of each is common.
    short = F.ceil(F.col("n") * 2 * similarity / (100 + similarity)) - F.col("common")
    listed = group.select(
        "centre", "node", "n", "root", "common", F.size("outside").alias("n_out"),
        (F.size("outside") - F.greatest(short, F.lit(1)) + 1).alias("as_small"),
        (F.size("outside") - F.greatest(least - F.col("common"), F.lit(1)) + 1).alias("as_large"),
        F.explode("outside").alias("element"),
    )
    often = listed.groupBy("centre", "element").agg(F.count("*").alias("often")).where("often > 1")
    met = listed.join(often.hint("merge"), ["centre", "element"])
    of_node = Window.partitionBy("centre", "node")
    ranked = materialize(
        met.withColumns({"met": F.count("*").over(of_node), "place": F.row_number().over(of_node.orderBy("often", "element"))})
        .withColumn("place", F.col("place") + F.col("n_out") - F.col("met"))
        .where("place <= greatest(as_small, as_large)"),
        "prefixes",
    )

    def role(suffix: str) -> DataFrame:
        names = ("node", "n", "root", "common", "n_out")
        return ranked.where(f"place <= as_{suffix}").select("centre", "element", *[F.col(c).alias(f"{c}_{suffix}") for c in names])

    inner = F.least("common_small", "common_large") + F.least("n_out_small", "n_out_large")
    outside = role("small").join(role("large").hint("merge"), ["centre", "element"]).where(
        ((F.col("n_small") < F.col("n_large")) | ((F.col("n_small") == F.col("n_large")) & (F.col("node_small") < F.col("node_large"))))
        & (F.col("root_small") != F.col("root_large")) & could_link("n_small", "n_large", similarity) & enough(inner, "n_small", "n_large", similarity)
    ).select(F.col("node_small").alias("a"), F.col("n_small").alias("n_a"), F.col("node_large").alias("b"), F.col("n_large").alias("n_b"))
    return inside.unionByName(outside)


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE_WORDS, similarity: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text",
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, keeper, text_hash.

    Documents are linked when 100 * shared >= similarity * all of their word shingles. ``component_id`` is the
    smallest doc_id reachable over links, ``kept`` says whether it is the row's own; with null ids only, both are
    null and true. A text without words, null or empty, is linked with nothing. Rows may repeat; ``keeper`` marks one row
    of each component, also among rows of one id. Extra columns are ignored, no rows give no rows.
    """
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_hash(text).alias("text_hash")
    )
    known = materialize(sketches(plain, width, bands, rows).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    nodes = materialize(known.where("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("node"), F.count("*").alias("copies")), "nodes")
    distinct = known.join(nodes.select(F.col("node").alias("row_id")), "row_id", "left_semi")

    exploded = distinct.select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = materialize(exploded.join(shared.hint("merge"), "key"), "buckets")
    company = buckets.groupBy("node").agg(F.sum("members").alias("company"))
    best = F.max(F.struct("company", (-F.col("node")).alias("other"), "n")).alias("best")
    centres = buckets.join(company.hint("merge"), "node").groupBy("key").agg(best)
    buckets = materialize(
        buckets.join(centres.select("key", (-F.col("best.other")).alias("centre"), F.col("best.n").alias("n_centre")).hint("merge"), "key"), "centred"
    )
    of_row = distinct.select(F.col("row_id").alias("node"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    needed = of_row.join(buckets.select("node").distinct(), "node", "left_semi")
    found = plain.join(needed.hint("merge"), (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = materialize(full_sets(found.select("node", "text"), width).dropDuplicates(["node"]), "sets")

    large = F.col("members") > SMALL_BUCKET
    stars = (
        buckets.where("node != centre")
        .groupBy("centre", "node")
        .agg(F.first("n_centre").alias("n_a"), F.first("n").alias("n_b"), F.max(large).alias("large"))
        .select(F.col("centre").alias("a"), "n_a", F.col("node").alias("b"), "n_b", "large")
        .where(F.col("large") | could_link("n_a", "n_b", similarity))
    )
    stars = materialize(compared(stars, sets, F.when(F.col("large"), F.array_except("of_b", "of_a")).alias("outside")), "stars")
    linked = enough(F.col("common"), "n_a", "n_b", similarity)
    groups = components(stars.where(linked).select("a", "b"), "a", "b")
    reached = groups.select("node", F.col("root").alias("reached"))
    rooted = materialize(buckets.join(reached, "node", "left").withColumn("root", F.coalesce("reached", "node")).drop("reached"), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_buckets = materialize(rooted.join(mixed.hint("merge"), "key", "left_semi"), "open-buckets")
    few = pairs_within(open_buckets.where(~large).select("key", "node", "n", "root"), ["key"], "node", ["n", "root"])
    few = few.where((F.col("root_a") != F.col("root_b")) & could_link("n_a", "n_b", similarity)).select("a", "n_a", "b", "n_b")
    group = open_buckets.where(large & (F.col("node") != F.col("centre"))).select("centre", "node", "n", "root").distinct()
    known_star = stars.where("large").select(F.col("a").alias("c"), F.col("b").alias("of"), "common", "outside", linked.alias("linked"))
    group = group.join(known_star.hint("merge"), (F.col("centre") == F.col("c")) & (F.col("node") == F.col("of")))
    many = around_centres(materialize(group.drop("c", "of"), "groups"), similarity)
    pairs = few.unionByName(many.select("a", "n_a", "b", "n_b")).distinct()
    more = compared(pairs, sets).where(enough(F.col("common"), "n_a", "n_b", similarity)).select("a", "b")
    more = materialize(more, "links")
    if more.head(1):
        groups = components(groups.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")

    # What is known of the sets of many copies, and of large components, goes to their rows, not the rows to one task.
    of_node = nodes.join(groups.select(F.col("node").alias("member"), "root"), F.col("node") == F.col("member"), "left")
    of_node = materialize(of_node.select("set_key", "copies", F.coalesce("root", "node").alias("root")), "roots")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    columns = ("doc_id", "text_hash", "n_shingles", "row_id")
    placed = attach(known.where("set_key is not null"), of_node, "set_key", "copies", total).select(*columns, "root")
    placed = materialize(placed, "placed")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    best = placed.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("members"))
    best = materialize(best.select("root", "first.id", "first.row", "members"), "components")
    alone = known.where("set_key is null").select(*columns, F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    found = attach(placed, best, "root", "members", total).select(*columns, "id", "row").unionByName(alone)
    return found.select(
        "doc_id", "n_shingles", F.col("id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"), (F.col("row_id") == F.col("row")).alias("keeper"), "text_hash"
    )


def unlike_documents(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the one with the smallest id (null last)."""
    found = near_duplicates(docs, width)
    return keep_rows(docs, found.select("doc_id", "text_hash", F.col("keeper").alias("kept")))


def op10_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: sets of two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM worded WHERE len(w) > 1)
  UNION ALL SELECT doc_id, w[1] FROM worded WHERE len(w) = 1
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM shingled
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y
    ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), arcs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN arcs l ON l.a = r.b
), component AS (SELECT a, min(b) AS id FROM reach GROUP BY a),
counted AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.id AS component_id, d.doc_id = c.id AS kept
FROM documents d JOIN component c ON c.a = d.doc_id LEFT JOIN counted t ON t.doc_id = d.doc_id
"""
