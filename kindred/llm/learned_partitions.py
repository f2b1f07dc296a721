"""Approximate nearest neighbours by learned partitions of a neighbour graph.

A bounded sample of the vectors gets a graph of nearest neighbours. The graph is cut into equal parts by recursive
bisection: the second eigenvector of its random walk orders the nodes, the median splits them, and swaps of nodes
with more neighbours on the other side shorten the cut. A small network with one hidden layer then learns from a vector
how likely its neighbours are in each part. It places every row of the table in its most probable part, and routes a
query to the several most probable ones. How many those are is measured on a part of the sample that took no part in
training: as few as find the wanted share of its nearest neighbours. On vectors without structure that
can be most of the parts; on clustered ones it is few.

Rows of the chosen parts are reranked by their inner products in double precision. A part is cut into blocks of
bounded size and its queries into chunks, and each combination is a group of its own, so that a part, a
vector or a query that occurs a million times is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.texts import materialize, table

#: Most vectors of the sample, and most numbers in it; the parts are at most one for 128 sampled vectors.
SAMPLE_ROWS = 8192
SAMPLE_NUMBERS = 4_000_000
SAMPLE_PER_PART = 128
#: Rows of the table that a part should hold, as long as the sample allows so many parts.
PART_ROWS = 128
#: Neighbours of a node of the graph, hidden units, passes over the sample, and rows of a training step.
NEIGHBOURS = 50
HIDDEN = 128
EPOCHS = 10
STEP_ROWS = 128
#: Share of the nearest neighbours of held-out sampled vectors that the parts searched must hold.
RECALL = 0.95
#: Rows of a block and queries of a chunk.
BLOCK_ROWS = 4096
CHUNK_ROWS = 1024
SEED = 7


def nearest_in(vectors: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``vectors`` with the largest inner products with each query, but for the query itself, best first."""
    found = np.empty((len(queries), k), dtype=np.int64)
    for low in range(0, len(queries), 1024):
        own = queries[low : low + 1024]
        scores = vectors[own] @ vectors.T
        scores[np.arange(len(own)), own] = -np.inf
        part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable")
        found[low : low + 1024] = np.take_along_axis(part, order, axis=1)
    return found


def bisect(edges: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, total: int, random: np.random.Generator) -> np.ndarray:
    """Which of the sorted ``nodes`` are on the second side of a balanced cut of their graph."""
    n = len(nodes)
    place = np.full(total, -1)
    place[nodes] = np.arange(n)
    u, v = place[edges[0]], place[edges[1]]
    inside = (u >= 0) & (v >= 0)
    u, v = u[inside], v[inside]
    degree = np.bincount(u, minlength=n) + 1.0  # each node counts as its own neighbour: no node is without one
    x = random.standard_normal(n)
    for _ in range(60):
        x -= (degree @ x) / degree.sum()  # the first eigenvector is constant
        x = (np.bincount(u, weights=x[v], minlength=n) + x) / degree
        x /= np.abs(x).max() or 1.0
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        # Neighbours on the other side less those on the own side; the best of both sides change places.
        other = np.bincount(u, weights=(side[u] != side[v]).astype(float), minlength=n)
        gain = 2 * other - (degree - 1)
        ours, theirs = (np.flatnonzero(s & (gain > 0)) for s in (side, ~side))
        swaps = min(len(ours), len(theirs)) // 2
        if not swaps:
            break
        for members in (ours, theirs):
            best = members[np.argsort(-gain[members], kind="stable")[:swaps]]
            side[best] = ~side[best]
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, random: np.random.Generator) -> np.ndarray:
    """Part of each node of a graph given by its neighbour lists; parts are a power of two and of equal size."""
    total, k = neighbours.shape
    u, v = np.repeat(np.arange(total), k), neighbours.ravel()
    edges = (np.concatenate((u, v)), np.concatenate((v, u)))
    part = np.zeros(total, dtype=np.int64)
    count = 1
    while count < parts:
        halves = np.zeros(total, dtype=np.int64)
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            halves[nodes] = bisect(edges, nodes, total, random)
        part = 2 * part + halves
        count *= 2
    return part


@dataclass(frozen=True)
class Router:
    """The network: from directions of vectors to the probability of each part."""

    into: np.ndarray
    into_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.out.shape[1]

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(directions(vectors) @ self.into + self.into_bias, 0) @ self.out + self.out_bias

    def most_probable(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most probable parts of each vector, best first."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, :count]


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to the length sqrt(n); the largest number goes first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled * (np.sqrt(vectors.shape[1]) / np.linalg.norm(scaled, axis=1, keepdims=True))


def train(vectors: np.ndarray, wanted: np.ndarray, random: np.random.Generator) -> list[np.ndarray]:
    """Weights of the network that gives the wanted probabilities, by Adam on the cross-entropy."""
    x = directions(vectors)
    n, size = x.shape
    parts = wanted.shape[1]
    weights = [random.standard_normal((size, HIDDEN)) * np.sqrt(2 / size), np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) * 0.01, np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, steps = 0, EPOCHS * max(1, -(-n // STEP_ROWS))
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for low in range(0, n, STEP_ROWS):
            rows = order[low : low + STEP_ROWS]
            hidden = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            logits -= logits.max(axis=1, keepdims=True)
            given = np.exp(logits)
            error = (given / given.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            back = (error @ weights[2].T) * (hidden > 0)
            gradient = [x[rows].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], error.sum(0)]
            rate = 0.003 * (1 - step / steps)
            step += 1
            for w, g, m, s in zip(weights, gradient, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return weights


def balanced(logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias, moved until rows with these logits are spread evenly over their most probable parts."""
    shift = np.zeros_like(bias)
    for _ in range(200):
        rows = np.bincount((logits + shift).argmax(axis=1), minlength=len(bias)) + 1.0
        shift -= 0.05 * np.log(rows / rows.mean())
    return bias + shift


def fit(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router | None:
    """The router for a sample of vectors; none if the sample allows one part only."""
    n = len(sample)
    limit = 1
    while 2 * limit <= min(parts, n // SAMPLE_PER_PART):
        limit *= 2
    if limit == 1:
        return None
    random = np.random.default_rng(SEED)
    apart = np.arange(n) % 8 == 0  # the sample comes in the order of a hash
    known = sample[~apart]
    graph = nearest_in(known, np.arange(len(known)), min(NEIGHBOURS, len(known) - 1))
    part = balanced_parts(graph, limit, random)
    wanted = np.zeros((len(known), limit))
    np.add.at(wanted, (np.repeat(np.arange(len(known)), graph.shape[1]), part[graph].ravel()), 1.0)
    wanted[np.arange(len(known)), part] += graph.shape[1] / 2  # its own part: it is placed there too
    weights = train(known, wanted / wanted.sum(axis=1, keepdims=True), random)
    router = Router(*weights[:3], balanced(Router(*weights, probes=limit).logits(known), weights[3]), probes=limit)
    # Parts of all sampled rows as the network places them, and how far down a held-out row's list its neighbours are.
    placed = router.most_probable(sample, 1)[:, 0]
    queries = np.flatnonzero(apart)
    neighbours = nearest_in(sample, queries, min(k, n - 1))
    rank = np.argsort(router.most_probable(sample[queries], limit), axis=1)
    depth = np.take_along_axis(rank, placed[neighbours], axis=1)
    reached = np.cumsum(np.bincount(depth.ravel(), minlength=limit)) / depth.size
    return replace(router, probes=min(limit, int(np.searchsorted(reached, recall)) + 1))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.empty((0, 1))


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, as long and array of doubles.

    Left out are rows without id, and vectors that are null or empty, hold a null, NaN or infinity, are zero, or are
    not as long as most vectors of the table (of equally frequent lengths the larger counts). Rows of one id count
    as one, that with the smallest vector.
    """
    plain = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = plain.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(~bad).where(F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    good = good.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    repeated = materialize(good.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if not repeated.head(1):
        return good
    return good.join(repeated, "id", "left_anti").unionByName(good.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")))


def sampled(vectors: DataFrame, rows: int = SAMPLE_ROWS, numbers: int = SAMPLE_NUMBERS) -> np.ndarray:
    """At most ``rows`` vectors, and no more than ``numbers`` numbers, drawn by a hash of their ids."""
    size = vectors.select(F.size("vector").alias("n")).head()
    if size is None:
        return np.empty((0, 1))
    most = max(1, min(rows, numbers // size["n"]))
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
    return matrix(drawn.column(0), drawn.num_rows)


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best rows but those of its own id: (query, ids, scores).

    The product of the two matrices only shortlists. Scores are then summed row by row in one fixed order, so that equal vectors
    get equal scores whatever block they are in.
    """
    lengths = np.linalg.norm(rows, axis=1).max() if len(rows) else 0.0
    for low in range(0, len(queries), 256):
        own = queries[low : low + 256]
        rough = own @ rows.T
        rough[query_ids[low : low + 256, None] == row_ids[None, :]] = -np.inf
        kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(own), -np.inf)
        slack = 1e-12 * np.linalg.norm(own, axis=1) * lengths
        for i, scores in enumerate(rough):
            near = np.flatnonzero((scores >= kth[i] - slack[i]) & (row_ids != query_ids[low + i]))
            exact = (rows[near] * own[i]).sum(axis=1)
            order = np.lexsort((row_ids[near], -exact))[:k]
            yield int(query_ids[low + i]), row_ids[near][order], exact[order]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    Both tables have ``id`` and ``vector`` as ``usable`` gives them. Nearness is the inner product in double
    precision, ties go to the smaller id, and rows of the query's own id are left out. A query has fewer than ``k`` rows only
    where the parts searched hold fewer; tables of fewer rows than two parts need are searched whole. No queries
    or rows give no rows.
    """
    spark = rows.sparkSession
    sample = sampled(rows)
    count = rows.count() if len(sample) >= 2 * SAMPLE_PER_PART else 0
    router = fit(sample, max(1, count // part_rows), k, recall)
    # A part holds few rows where the table is small: its nearest k must fit in what is searched.
    parts, probes = (router.parts, router.probes) if router else (1, 1)
    model = spark.sparkContext.broadcast(router)

    def placing(most: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not model.value:
                    chosen = np.zeros((batch.num_rows, 1), dtype=np.int64)
                elif batch.num_rows:
                    chosen = model.value.most_probable(matrix(batch.column(1), batch.num_rows), most)
                else:
                    continue
                lists = pa.array(list(chosen.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "vector", "parts"])

        return place

    schema = "id long, vector array<double>, parts array<int>"
    placed = materialize(rows.select("id", "vector").mapInArrow(placing(1), schema).select("id", "vector", F.explode("parts").alias("part")), "placed-vectors")
    routed = materialize(queries.select("id", "vector").mapInArrow(placing(probes), schema).select("id", "vector", F.explode("parts").alias("part")), "routed-queries")

    def sizes(table: DataFrame, most: int) -> list:
        found = {r["part"]: r["count"] for r in table.groupBy("part").count().collect()}  # at most one row a part
        return F.array(*[F.lit(max(1, -(-found.get(p, 0) // most))) for p in range(parts)])

    blocks, chunks = sizes(placed, BLOCK_ROWS), sizes(routed, CHUNK_ROWS)
    own, all_of = F.col("part") + 1, F.sequence
    cells = ("part", "block", "chunk")
    left = placed.select(
        "part", F.pmod(F.xxhash64("id"), F.element_at(blocks, own)).cast("int").alias("block"),
        F.explode(all_of(F.lit(0), F.element_at(chunks, own) - 1)).alias("chunk"), "id", "vector",
    )
    right = routed.select(
        "part", F.explode(all_of(F.lit(0), F.element_at(blocks, own) - 1)).alias("block"),
        F.pmod(F.xxhash64("id"), F.element_at(chunks, own)).cast("int").alias("chunk"), "id", "vector",
    )

    def search(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if block.num_rows and chunk.num_rows:
            ids, asked = (np.asarray(t.column("id"), dtype=np.int64) for t in (block, chunk))
            found = best_of(matrix(chunk.column("vector"), chunk.num_rows), asked, matrix(block.column("vector"), block.num_rows), ids, k)
            for query, near, score in found:
                for column, values in zip(out, (np.full(len(near), query), near, score), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    hits = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(search, "query_id long, vec_id long, score double")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of each vector whose id is divisible by 20, among all."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("id % 20 = 0"))
