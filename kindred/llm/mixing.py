"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Capacity flows from patterns to
the sources' quotas; a pattern's words cost more each further time they are used, so that the cheapest flow repeats as
little as the quotas allow and spreads repeats. The graph has one node per pattern and source, whatever the corpus.
A pattern then takes each of its documents so many whole times, and once more a seeded part of them.

That part is drawn per size class (sizes double from class to class) in the order of a seeded hash: hash buckets are
summed with partial aggregates, buckets before the cut are taken as they are, and only the documents of the bucket
at the cut, a 4096th of a large class, are put in order. The few documents next in order at each class's cut are taken
or left, the largest first, by what the pattern still lacks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.texts import materialize, table, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 17
BUCKETS = 4096
#: Rows of a size class that a zone of buckets should hold at least, and how many beyond the cut may fill the gap.
ZONE_ROWS = 64
CANDIDATES = 16
#: Patterns the driver's graph may have; beyond, group sources first. Checked, not cut.
MAX_PATTERNS = 100_000
#: Cells (pattern and size class) up to which their cuts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 50_000


def capped_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Each source's target: ``share`` of all sizes by weight, none above ``most`` times its size.

    Weights repeat over the sources in code point order, null last. What a cap cuts off is shared out again by weight
    among the others until no target is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target: dict[str | None, float] = {}
    rest, open_sources = share * sum(sizes.values()), list(order)
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        above = [s for s in open_sources if rest * weight[s] / total > most * sizes[s]]
        if not above:
            target.update({s: rest * weight[s] / total for s in open_sources})
            break
        for s in above:
            target[s] = float(most * sizes[s])
        rest -= sum(target[s] for s in above)
        open_sources = [s for s in open_sources if s not in target]
    return target


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MAX_REPEATS) -> list[int]:
    """Words each pattern gives: the cheapest of the largest flows from patterns to source quotas.

    ``patterns`` are (sources, size). The k-th use of a pattern's words costs 2 k - 1 each, for k up to ``most``.
    Shortest augmenting paths (Bellman-Ford with a queue) on the residual graph.
    """
    start, end = 0, 1 + len(patterns) + len(quotas)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[u].append(len(to)), to.append(v), room.append(c), cost.append(p)

    for k, (sources, size) in enumerate(patterns):
        for use in range(1, most + 1):
            arc(start, 1 + k, size, 2 * use - 1)
        for s in sources:
            arc(1 + k, 1 + len(patterns) + s, most * size, 0)
    for s, quota in enumerate(quotas):
        arc(1 + len(patterns) + s, end, quota, 0)
    while True:
        distance, via, queued, queue = [math.inf] * (end + 1), [-1] * (end + 1), [False] * (end + 1), [start]
        distance[start] = 0
        for node in queue:
            queued[node] = False
            for e in graph[node]:
                if room[e] > 0 and distance[node] + cost[e] < distance[to[e]]:
                    distance[to[e]], via[to[e]] = distance[node] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if math.isinf(distance[end]):
            break
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = to[via[node] ^ 1]
        pushed = min(room[e] for e in path)
        for e in path:
            room[e] -= pushed
            room[e ^ 1] += pushed
    given = [0] * len(patterns)
    for e in graph[start]:
        given[to[e] - 1] += room[e ^ 1]
    return given


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int = MAX_REPEATS) -> list[int]:
    """As ``min_cost_flow``, for each connected part of the graph of patterns and sources apart.

    A source and a pattern that meet nothing else need no search: the pattern gives the quota, if it has so much.
    """
    root = list(range(len(quotas)))

    def find(s: int) -> int:
        while root[s] != s:
            root[s] = root[root[s]]
            s = root[s]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            root[find(s)] = find(sources[0])
    parts: dict[int, list[int]] = {}
    for k, (sources, _) in enumerate(patterns):
        if sources:
            parts.setdefault(find(sources[0]), []).append(k)
    given = [0] * len(patterns)
    for own in parts.values():
        sources = sorted({s for k in own for s in patterns[k][0]})
        if len(own) == len(sources) == 1:
            given[own[0]] = min(quotas[sources[0]], most * patterns[own[0]][1])
            continue
        if len(own) > MAX_PATTERNS:
            raise ValueError(f"{len(own)} membership patterns share sources; the flow's graph takes {MAX_PATTERNS}")
        number = {s: i for i, s in enumerate(sources)}
        found = min_cost_flow([(tuple(number[s] for s in patterns[k][0]), patterns[k][1]) for k in own], [quotas[s] for s in sources], most)
        for k, words in zip(own, found, strict=True):
            given[k] = words
    return given


def zone_width(rows: int) -> int:
    """Buckets of a zone: one for large classes, more for small ones, so that a zone has some rows to choose from."""
    return BUCKETS >> max(0, min(BUCKETS, rows // ZONE_ROWS).bit_length() - 1)


def mix(
    rows: DataFrame, quotas: Callable[[dict[str | None, int]], dict[str | None, float]] = capped_targets, most: int = MAX_REPEATS, seed: int = SEED
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """Adds ``epochs``, how often the mix takes each row; also gives the sources' sizes and targets.

    ``rows`` needs the columns doc_id, size (long, not null) and members (array of source names, null being a
    source too); others are handed through. ``quotas`` makes targets from the sources' sizes, which count a
    document in each of its sources. Rows of a pattern without words, or without a source, are taken 0 times. Reruns
    agree: the order is a hash of seed, doc_id, size and members, and rows alike in all of these are alike to the mix.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns(
        {
            "pattern": F.to_json(F.array_sort(F.array_distinct("members"))),
            "class": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"),
        }
    ).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size", "pattern"))
    keyed = keyed.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    buckets = materialize(
        keyed.where("size > 0").groupBy("pattern", "class", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("members").alias("members")),
        "mix-buckets",
    )
    cells = buckets.groupBy("pattern", "class").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.first("members").alias("members")).collect()
    members: dict[str, tuple] = {}
    size_of: dict[str, int] = {}
    for c in cells:
        members[c["pattern"]] = tuple(dict.fromkeys(c["members"]))
        size_of[c["pattern"]] = size_of.get(c["pattern"], 0) + c["size"]
    sizes: dict[str | None, int] = {}
    for row in keyed.select(F.explode("members").alias("source")).distinct().collect():
        sizes[row["source"]] = 0
    for p, size in size_of.items():
        for s in members[p]:
            sizes[s] += size
    targets = quotas(sizes)
    sources, names = sorted(sizes, key=lambda s: (s is None, s or "")), sorted(size_of)
    number = {s: k for k, s in enumerate(sources)}
    given = route([(tuple(number[s] for s in members[p]), size_of[p]) for p in names], [round(targets[s]) for s in sources], most)
    whole = {p: min(g // size_of[p], most) for p, g in zip(names, given, strict=True)}
    part = {p: g - whole[p] * size_of[p] for p, g in zip(names, given, strict=True)}

    # Each class's cut: the zone of buckets in which the seeded order reaches the class's share of the part.
    share = {(c["pattern"], c["class"]): part[c["pattern"]] * c["size"] // size_of[c["pattern"]] for c in cells}
    wanted = spark.createDataFrame(
        [(c["pattern"], c["class"], share[c["pattern"], c["class"]], zone_width(c["n"])) for c in cells],
        "pattern string, class int, quota long, width int",
    )
    small = F.broadcast if len(cells) <= BROADCAST_CELLS else (lambda df: df)
    zones = (
        buckets.join(small(wanted), ["pattern", "class"])
        .withColumn("first", F.col("bucket") - F.pmod(F.col("bucket"), F.col("width")))
        .groupBy("pattern", "class", "quota", "width", "first")
        .agg(F.sum("size").alias("size"))
    )
    upto = Window.partitionBy("pattern", "class").orderBy("first")
    cuts = materialize(
        zones.withColumn("reached", F.sum("size").over(upto))
        .where("quota < reached and quota >= reached - size")
        .select("pattern", "class", "first", (F.col("first") + F.col("width")).alias("beyond"), (F.col("quota") - F.col("reached") + F.col("size")).alias("within")),
        "mix-cuts",
    )
    inside = Window.partitionBy("pattern", "class").orderBy("order", "doc_id", "size")

    def at_cut(columns: list[str]) -> DataFrame:
        """The rows in the cuts' zones, numbered, with the words up to each."""
        return (
            keyed.select(*columns, "pattern", "class", "bucket", "order", *[c for c in ("doc_id", "size") if c not in columns])
            .join(small(cuts), ["pattern", "class"])
            .where("bucket >= first and bucket < beyond")
            .withColumns({"number": F.row_number().over(inside), "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
        )

    # The rows up to the cut are taken; of the next few in each class, those that still fit, the largest first.
    edge = (
        at_cut([]).where("upto > within")
        .withColumn("next", F.row_number().over(Window.partitionBy("pattern", "class").orderBy("number")))
        .where(F.col("next") <= CANDIDATES)
        .select("pattern", "class", "number", "next", "size", "upto", "within")
        .collect()
    )
    lacking = dict(part)
    for (p, _), n in share.items():
        lacking[p] -= n
    under: dict[tuple[str, int], int] = {}
    for e in edge:
        if e["next"] == 1:
            under[e["pattern"], e["class"]] = e["number"] - 1
            lacking[e["pattern"]] += e["within"] - (e["upto"] - e["size"])
    extra: dict[tuple[str, int], list[int]] = {cell: [] for cell in under}
    left: dict[str, tuple[int, tuple[str, int], int]] = {}
    for e in sorted(edge, key=lambda e: (-e["size"], e["class"], e["number"])):
        p, cell = e["pattern"], (e["pattern"], e["class"])
        if e["size"] <= lacking[p]:
            lacking[p] -= e["size"]
            extra[cell].append(e["number"])
        else:
            left[p] = (e["size"], cell, e["number"])  # ends as the smallest one left
    for p, (size, cell, at) in left.items():
        if size < 2 * lacking[p]:  # nearer with it than without
            extra[cell].append(at)
    decided = spark.createDataFrame(
        [(*cell, under[cell], extra[cell], whole[cell[0]]) for cell in under], "pattern string, class int, under int, extra array<int>, uses int"
    )
    carried = rows.columns
    base = spark.createDataFrame(
        [(c["pattern"], c["class"], whole[c["pattern"]]) for c in cells] + [(None, None, 0)], "pattern string, class int, uses int"
    ).join(small(cuts.select("pattern", "class", "first", "beyond")), ["pattern", "class"], "left")
    plain = keyed.join(small(base), ["pattern", "class"], "left").where("first is null or bucket < first or bucket >= beyond")
    plain = plain.withColumn("epochs", F.coalesce("uses", F.lit(0)) + F.coalesce((F.col("bucket") < F.col("first")).cast("int"), F.lit(0)))
    cut = at_cut(carried).join(small(decided), ["pattern", "class"], "left")
    cut = cut.withColumn("epochs", F.coalesce("uses", F.lit(0)) + F.coalesce(F.col("number") <= F.col("under"), F.lit(True)).cast("int"))
    cut = cut.withColumn("epochs", F.col("epochs") + F.coalesce(F.array_contains("extra", F.col("number")), F.lit(False)).cast("int"))
    return plain.select(*carried, "epochs").unionByName(cut.select(*carried, "epochs")), sizes, targets


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix of ``docs`` by their source, each as often as the mix takes it.

    All columns stay, whatever their names. A null text has no words; documents without words are left out.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("whole"), "doc_id", F.size(words(F.col("text"))).cast("long").alias("size"), F.array("source").alias("members"))
    mixed, _, _ = mix(rows)
    return mixed.where("epochs > 0").select("whole", F.explode(F.sequence(F.lit(1), "epochs")).alias("epoch")).select("whole.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by their source: sizes in words, targets, and the words the mix takes of each."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    rows = materialize(sized.withColumn("members", F.array("source")), "mix-rows")
    mixed, sizes, targets = mix(rows)
    sources = spark.createDataFrame([(s, sizes[s], float(targets[s])) for s in sizes], "name string, source_size long, target double")
    sources = F.broadcast(sources) if len(sizes) <= BROADCAST_CELLS else sources
    return mixed.join(sources, F.col("source").eqNullSafe(F.col("name")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "source", "epochs"
    )
