"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import materialize


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: one edge (node, smallest node of its tree) per node that is not a root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    for low in range(0, len(nodes), 65536):
        part = nodes[low : low + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([find(int(x)) for x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another: root is the smallest node it can reach.

    Union-find inside each task first reduces the edges to a forest. Then large-star and small-star rounds link
    every node to its smallest neighbour until all trees are stars; each round is a few joins and aggregates on
    narrow rows and is written, so that lost executors cost one round at most.
    """
    spark = edges.sparkSession
    stars = materialize(
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u != v")
        .mapInArrow(spanning_forest, "u long, v long")
        .distinct(),
        "forest",
    )
    while True:
        # Done when every node hangs on one root that itself hangs on nothing.
        many = stars.groupBy("u").count().where("count > 1").select("u")
        chained = stars.select(F.col("v").alias("u")).join(stars.select("u"), "u", "left_semi")
        if not many.unionByName(chained).head(1):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u != v"), "large-star")
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(lower, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        stars = materialize(small, "small-star")
