import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing as X
from kindred.llm.texts import table


def test_targets_are_capped_and_shared_again():
    got = X.capped_targets({"a": 10, "b": 1000, "c": 1000, None: 0})
    # Of 3015 words a (weight 5) may take 20 and the empty null source none; b (2) and c (1) share 2995 up to 2000.
    assert got == {"a": 20.0, None: 0.0, "b": pytest.approx(2995 * 2 / 3), "c": pytest.approx(2995 / 3)}


def test_flow_repeats_as_little_as_quotas_allow():
    # Source 0 can only use pattern 0; the shared pattern must serve source 1.
    assert X.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 0)], [10, 10]) == [10, 10, 0]
    assert X.min_cost_flow([((0,), 10), ((0, 1), 10)], [15, 20]) == [15, 20]
    assert X.min_cost_flow([((0,), 10), ((0, 1), 10)], [100, 100]) == [20, 20]
    assert X.min_cost_flow([], [5]) == [0] * 0


def test_parts_of_the_graph_are_routed_apart():
    """The same cheapest flow, and a source for itself costs no search, however many there are."""
    rng = random.Random(1)
    for _ in range(30):
        quotas = [rng.randint(0, 60) for _ in range(9)]
        patterns = [(tuple(sorted(rng.sample(range(9), rng.choice([1, 1, 1, 2, 3])))), rng.randint(0, 40)) for _ in range(rng.randint(0, 9))]
        patterns = list(dict(patterns).items())
        apart, whole = X.route(patterns, quotas), X.min_cost_flow(patterns, quotas)
        cost = lambda given: sum(g + max(0, g - size) * 2 for g, (_, size) in zip(given, patterns, strict=True))
        assert sum(apart) == sum(whole) and cost(apart) == cost(whole) and all(g <= 2 * size for g, (_, size) in zip(apart, patterns, strict=True))
    many = 200_000
    assert X.route([((k,), 10) for k in range(many)], [k % 30 for k in range(many)]) == [min(k % 30, 20) for k in range(many)]


def test_columns_of_the_registered_query_by_brute_force(spark):
    """Sizes, source sizes and targets of every document, and how near the words taken come."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    of_source = defaultdict(int)
    for r in docs:
        of_source[r["source"]] += size[r["doc_id"]]
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, 1.5 * sum(of_source.values())
    while True:  # sources above twice their size stop there, and the rest is shared again
        rest = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * of_source[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * of_source[s]
            left -= target[s]
    got = X.op8_source_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of_source[r["source"]]) and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.01) for s in target)
    again = {r["doc_id"]: r["taken"] for r in X.op8_source_mixing(spark, sf).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def documents_of(spark, n=4000):
    ids = spark.range(n)
    return ids.select(
        F.col("id").alias("doc_id"), (1 + F.pmod(F.xxhash64("id"), F.lit(300))).cast("long").alias("size"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("big"))).when(F.col("id") % 3 == 1, F.array(F.lit("big"), F.lit("small")))
        .when(F.col("id") % 50 == 2, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("small"))).alias("members"),
        F.lit("z").alias("bucket2"),
    )


def test_patterns_meet_the_flow_and_reruns_agree(spark):
    rows = documents_of(spark)
    mixed, sizes, targets = X.mix(rows)
    got = mixed.collect()
    assert len(got) == 4000 and {r["epochs"] for r in got} <= {0, 1, 2} and sorted(sizes, key=str) == sorted(["big", "small", None], key=str)
    taken = sum(r["size"] * r["epochs"] for r in got)
    assert taken == pytest.approx(min(sum(targets.values()), 2 * sum(r["size"] for r in got)), rel=0.003)
    again = {r["doc_id"]: r["epochs"] for r in X.mix(rows.repartition(7))[0].collect()}
    assert again == {r["doc_id"]: r["epochs"] for r in got}


def test_each_source_comes_near_its_target(spark):
    rows = documents_of(spark).withColumn("members", F.slice("members", 1, 1))
    mixed, _, targets = X.mix(rows)
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["members"][0]] += r["size"] * r["epochs"]
    assert all(taken[s] == pytest.approx(targets[s], rel=0.01, abs=5) for s in targets)


def test_odd_rows_and_no_rows(odd, documents):
    taken = X.take(odd)
    assert taken.columns == odd.columns
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in taken.collect()}
    assert not {1, 2, 3} & set(words)  # nothing to take
    assert X.take(documents([])).count() == 0
