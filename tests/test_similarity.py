from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from kindred.functions.hashing import PRIME, coefficients
from kindred.operators import evaluate
from kindred.operators import minhash as M
from kindred.operators import pairs as P
from kindred.operators import similarity as S
from kindred.operators.evaluate import recall, sampled_recall
from kindred.operators.minhash import BandPlan, bucket_sizes, lsh_buckets, lsh_candidates, minhash_signatures, plan_bands, signature_rows

PLAN = BandPlan(2, 25, 0.0)


def pairs(df, a, b):
    rows = df.collect()
    found = {(r[a], r[b]): r["sim"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("support", [1, 2, 3, 5])
def test_item_pearson_equals_brute_force(rated, support):
    rows = brute.random_ratings(3, users=40, items=25, per_user=8)
    expected = brute.positive(brute.pearson_pairs(rows, 0, 1, support))
    assert pairs(S.item_similarity(rated(rows), support), "b1", "b2") == pytest.approx(expected, abs=2e-6)


@pytest.mark.parametrize("support", [1, 3])
def test_counts_with_held_out_keys(rated, support):
    rows = brute.random_ratings(4, users=30, items=20, per_user=6)
    expected = {k: n for k, (n, _) in brute.pearson_pairs(rows, 0, 1, support).items()}
    got = S.co_rating_counts(rated(rows), "user_id", "item_id", support).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == expected


def test_busiest_users_are_left_out_of_the_self_join(rated):
    """Two users who rated everything add no pair of their own, and still count in every pair."""
    rows = [(u, i, float(1 + (u + i * i) % 5)) for u in (100, 101) for i in range(60)]
    rows += [(u, i, float(1 + (u * i) % 5)) for u in range(5) for i in (u, u + 1, u + 2)]
    got = S.co_rating_counts(rated(rows), "user_id", "item_id", 3).collect()
    expected = {k: n for k, (n, _) in brute.pearson_pairs(rows, 0, 1, 3).items()}
    assert {(r["a"], r["b"]): r["n"] for r in got} == expected
    assert len(expected) < 60 * 59 // 2


def test_edge_cases(rated):
    two = [(u, i, float(u + i)) for u in (1, 2) for i in (1, 2)]
    flat = [(u, i, 3.0 if i == 3 else float(u)) for u in (1, 2, 3) for i in (3, 4)]
    assert S.item_similarity(rated(two)).count() == 0  # two co-raters only
    assert S.item_similarity(rated(flat)).count() == 0  # one item never varies
    three = [(u, i, float(u)) for u in (1, 2, 3) for i in (5, 6)]
    assert pairs(S.item_similarity(rated(three)), "b1", "b2") == {(5, 6): 1.0}


def banded_pairs(signatures, entity, rows_per_band):
    """Pairs that share a bucket, by comparing all signatures in plain Python."""
    sigs = {r[entity]: r["signature"] for r in signatures.collect()}
    width = rows_per_band
    return {
        (a, b)
        for a, b in combinations(sorted(sigs), 2)
        if any(sigs[a][k : k + width] == sigs[b][k : k + width] for k in range(0, 50, width))
    }


@pytest.mark.parametrize("rows_per_band", [1, 2, 5])
def test_models_keep_the_pairs_that_share_a_band(rated, rows_per_band):
    ratings = rated(brute.random_ratings(5, users=40, items=30, per_user=9))
    everything = pairs(S.user_similarity(ratings, lsh=False), "u1", "u2")
    banded = banded_pairs(minhash_signatures(ratings, "user_id", "item_id"), "user_id", rows_per_band)
    expected = {k: v for k, v in everything.items() if k in banded}
    assert pairs(S.user_similarity(ratings, rows=rows_per_band), "u1", "u2") == expected
    items = banded_pairs(minhash_signatures(ratings, "item_id", "user_id"), "item_id", rows_per_band)
    exact = pairs(S.item_jaccard(ratings, lsh=False), "b1", "b2")
    assert pairs(S.item_jaccard(ratings, rows=rows_per_band), "b1", "b2") == {k: v for k, v in exact.items() if k in items}


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5])
def test_jaccard_equals_brute_force(rated, threshold):
    rows = brute.random_ratings(6, users=50, items=30, per_user=3)
    got = S.jaccard_pairs(rated(rows), "item_id", "user_id", threshold).collect()
    expected = brute.jaccard_pairs(rows, 0, 1, threshold)
    assert {(r["a"], r["b"]): r["overlap"] for r in got} == {k: v[0] for k, v in expected.items()}
    assert all(0 <= r["jaccard"] <= 1 for r in got)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=40), st.sampled_from([0.05, 0.4]))
def test_jaccard_of_any_table(rated, cells, threshold):
    rows = [(u, i, 1.0) for u, i in cells]
    got = S.jaccard_pairs(rated(rows), "item_id", "user_id", threshold).collect()
    expected = brute.jaccard_pairs(rows, 0, 1, threshold)
    assert {(r["a"], r["b"]): r["overlap"] for r in got} == {k: v[0] for k, v in expected.items()}


def test_recall_counts_what_lsh_found(rated):
    ratings = rated(brute.random_ratings(7, users=40, items=30, per_user=6))
    found, exact = S.item_jaccard(ratings, rows=2), S.item_jaccard(ratings, lsh=False)
    quality = recall(found, exact, "b1", "b2").first()
    assert quality["n_found"] == found.count() and quality["n_exact"] == exact.count()
    assert quality["recall"] == round(quality["n_found"] / quality["n_exact"], 6)


def test_identical_baskets_are_candidates_once(rated):
    rows = [(u, i, 1.0) for u in range(6) for i in (1, 2, 3)] + [(9, 77, 1.0), (10, 88, 1.0)]
    expected = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    assert sorted(map(tuple, S.lsh_co_raters(rated(rows), "item_id", "user_id").collect())) == expected
    signatures = minhash_signatures(rated(rows).select("user_id", "item_id"), "user_id", "item_id")
    assert sorted(map(tuple, lsh_candidates(signatures, "user_id", 2).collect())) == expected


@pytest.mark.parametrize("width", [1, 2, 5])
def test_search_finds_every_pair_that_shares_a_band(rated, width):
    ratings = rated(brute.random_ratings(12, users=60, items=15, per_user=4))
    signatures = minhash_signatures(ratings.select("user_id", "item_id"), "user_id", "item_id")
    got = list(map(tuple, lsh_candidates(signatures, "user_id", width).collect()))
    assert len(got) == len(set(got)) and set(got) == banded_pairs(signatures, "user_id", width)


def test_models_of_searched_pairs_are_parts_of_the_exact_ones(rated):
    ratings = rated(brute.random_ratings(13, users=50, items=25, per_user=7))
    found, exact = S.user_similarity_search(ratings, PLAN), S.user_similarity(ratings, lsh=False)
    assert found.exceptAll(exact).count() == 0 and found.count() > 0
    found, exact = S.item_jaccard_search(ratings, PLAN), S.item_jaccard(ratings, lsh=False)
    assert found.exceptAll(exact).count() == 0 and found.count() > 0


def test_constant_series_have_no_correlation(spark):
    """Sums of 200,000 values that no binary fraction represents leave residues far from zero."""
    n = 200_000
    table = spark.range(n).select(F.col("id").alias("user_id"), F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("item_id"))
    ratings = table.withColumn("rating", (F.lit(9) + F.col("item_id")) / 3)
    assert S.item_similarity(ratings).count() == 0
    varied = ratings.withColumn("rating", F.when(F.col("user_id") % 2 == 0, F.col("rating")).otherwise(F.col("rating") + 1))
    assert [tuple(r) for r in S.item_similarity(varied).collect()] == [(1, 2, 1.0)]


def test_buckets_count_who_meets(rated):
    signatures = minhash_signatures(rated([(u, i, 1.0) for u in (1, 2, 3) for i in (4, 5)]), "user_id", "item_id")
    assert [r["n"] for r in bucket_sizes(lsh_buckets(signatures, "user_id", rows=5)).collect()] == [3] * 10


def test_signatures_do_not_depend_on_partitions(rated):
    ratings = rated(brute.random_ratings(8, users=20, items=30, per_user=7))
    one = signature_rows(minhash_signatures(ratings.coalesce(1), "user_id", "item_id"), "user_id")
    many = signature_rows(minhash_signatures(ratings.repartition(13), "user_id", "item_id"), "user_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_string_ids(spark):
    rows = [(f"u{u}", f"i{i}", r) for u, i, r in brute.random_ratings(9, users=20, items=12, per_user=6)]
    ratings = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    assert pairs(S.user_similarity(ratings), "u1", "u2").keys() <= pairs(S.user_similarity(ratings, lsh=False), "u1", "u2").keys()


def test_one_user_with_a_third_of_all_rows(spark):
    """The items of the hot user would make 450 million pairs; only co-rated ones are made."""
    n = 30_000
    hot = spark.range(n).select(F.lit(-1).cast("bigint").alias("user_id"), F.col("id").alias("item_id"))
    others = spark.range(2 * n).select((F.col("id") % 5000).alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("item_id"))
    rows = hot.union(others).distinct()
    ratings = rows.withColumn("rating", (1 + F.pmod(F.xxhash64("item_id", "user_id"), F.lit(5))).cast("double"))
    got = {(r["a"], r["b"]): r["n"] for r in S.co_rating_counts(ratings, "user_id", "item_id", 3).collect()}
    baskets = {}
    for r in others.distinct().collect():
        baskets.setdefault(r["user_id"], []).append(r["item_id"])
    counts = Counter(pair for items in baskets.values() for pair in combinations(sorted(items), 2))
    assert got == {pair: k + 1 for pair, k in counts.items() if k + 1 >= 3}


@pytest.mark.parametrize(("threshold", "spread"), [(0.05, 1), (0.3, 1), (0.5, 3)])
def test_prefix_index_leaves_out_the_most_frequent_members_only(rated, threshold, spread):
    """Whatever a basket may spare of its members goes, and every similar pair still shares one that is left."""
    rows = brute.random_ratings(21, users=200, items=60, per_user=6) + [(u, i, 1.0) for u in (900, 901) for i in range(0, 60, spread)]
    rows += [(1000 + 80 * g + k, i, 1.0) for g in range(10) for k in range(80) for i in (2 * g, 2 * g + 1)]
    rows = list({(u, i): (u, i, r) for u, i, r in rows}.values())
    kept = {}
    for r in S.prefix_index(rated(rows), "item_id", "user_id", threshold).collect():
        kept.setdefault(r["item_id"], (r["size"], r["dropped"], set()))[2].add(r["user_id"])
    baskets = {i: set(own) for i, own in brute.by(rows, 1, 0).items()}
    often = Counter(u for u, _, _ in rows)
    assert set(kept) == set(baskets)
    for item, (size, dropped, members) in kept.items():
        assert size == len(baskets[item]) and dropped == size - len(members) <= threshold * size
        gone = baskets[item] - members
        assert all(often[u] * 2**0.25 >= max(often[v] for v in members) for u in gone)
    found = brute.jaccard_pairs(rows, 0, 1, threshold)
    assert found and all(kept[a][2] & kept[b][2] for a, b in found)


def test_members_common_to_all_are_not_joined_on(rated):
    """Large baskets that share three members with everyone, and one more with a few."""
    rows = [(u, i, 1.0) for u in (1, 2, 3) for i in range(200)] + [(100 + 70 * i + k, i, 1.0) for i in range(200) for k in range(70)]
    rows += [(5, i, 1.0) for i in (10, 11)] + [(6 + k, i, 1.0) for k in range(60) for i in (30, 31)]
    rows = list(dict.fromkeys(rows))
    kept = S.prefix_index(rated(rows), "item_id", "user_id", 0.2)
    assert kept.where("user_id in (1, 2, 3)").count() == 0
    got = {(r["a"], r["b"]): r["overlap"] for r in S.jaccard_pairs(rated(rows), "item_id", "user_id", 0.2).collect()}
    assert got == {(30, 31): 63}


@pytest.mark.parametrize(("block_rows", "hot"), [(2048, 1.0), (4, 1.0), (4, 0.0), (16, 0.02)])
def test_pairs_counted_from_lists(rated, monkeypatch, block_rows, hot):
    """Lists cut into blocks, and members hot or not, give the same counts and carried columns."""
    monkeypatch.setattr(P, "HOT_SHARE", hot)
    rows = brute.random_ratings(22, users=40, items=50, per_user=9)
    table = rated(rows).withColumn("twice", F.col("item_id") * 2)
    got = P.counted_pairs(table, "user_id", "item_id", ["twice"], F.col("twice_a") != 6, block_rows, pairs_per_task=50)
    counts = Counter(p for _, items in brute.by(rows, 0, 1).items() for p in combinations(sorted(items), 2) if p[0] != 3)
    found = [tuple(r) for r in got.select("a", "b", "n", "twice_a", "twice_b").collect()]
    assert sorted(found) == sorted((a, b, n, 2 * a, 2 * b) for (a, b), n in counts.items())


def test_plans_reach_their_recall_with_the_most_selective_bands():
    assert plan_bands(0.01, 0.9, 50) is None
    for similarity in (0.05, 0.2, 0.5, 0.8, 0.95, 1.0):
        for hashes in (50, 200):
            plan = plan_bands(similarity, 0.9, hashes)
            assert plan.recall >= 0.9 and plan.rows * plan.bands <= hashes
            more = plan.rows + 1
            assert more > hashes or 1 - (1 - similarity**more) ** (hashes // more) < 0.9


def test_a_search_is_made_where_it_pays(rated, monkeypatch):
    """Baskets alike in groups: few pairs share a bucket, so the search runs and finds its share; random ones are joined."""
    rows = [(1000 * g + u, 20 * g + i, float(1 + (u * i) % 5)) for g in range(40) for i in range(20) for u in range(60) if (u * 7 + i * 3) % 10]
    rows += [(u, i, 3.0) for u in range(50_000, 50_030) for i in range(0, 800, 2)]
    ratings = rated(rows)
    searched = []
    plain = S.lsh_candidates
    monkeypatch.setattr(S, "lsh_candidates", lambda *a, **k: searched.append(a[2]) or plain(*a, **k))
    found, exact = S.item_jaccard_search(ratings, threshold=0.6), S.item_jaccard(ratings, threshold=0.6, lsh=False)
    quality = recall(found, exact, "b1", "b2").first()
    assert searched == [plan_bands(0.6).rows] and quality["n_exact"] > 1000 and quality["recall"] >= 0.9
    assert found.exceptAll(exact).count() == 0
    few = rated(brute.random_ratings(23, users=60, items=40, per_user=8))
    assert S.item_jaccard_search(few).exceptAll(S.item_jaccard(few, lsh=False)).count() == 0 and len(searched) == 1


def test_recall_of_a_sample_holds_the_true_one(rated):
    """Over 20 samples of the entities; and all entities sampled give the exact recall."""
    rows = brute.random_ratings(31, users=150, items=120, per_user=9, hot_user=False)
    table = rated(rows).select("item_id", "user_id").cache()
    exact = S.jaccard_pairs(table, "item_id", "user_id", 0.05).cache()
    found = exact.where(F.pmod(F.xxhash64("a", "b"), F.lit(10)) < 7).select("a", "b").cache()
    true = found.count() / exact.count()
    whole = sampled_recall(found, table, "item_id", "user_id", 0.05, 1.0).first()
    assert whole["recall"] == round(true, 6) and whole["n_exact"] == 2 * exact.count() and whole["n_sampled"] == 120
    held = [sampled_recall(found, table, "item_id", "user_id", 0.05, 0.3, z=3.0, seed=k).first() for k in range(20)]
    assert all(r["low"] <= true <= r["high"] and r["high"] - r["low"] < 0.3 for r in held) and len({r["recall"] for r in held}) > 10
    none = sampled_recall(found, table, "item_id", "user_id", 0.05, 0.0).first()
    assert none["n_sampled"] == 0 and none["recall"] is None and none["low"] is None


def test_signatures_with_and_without_large_entities(spark, monkeypatch):
    """Members are shuffled, not partial signatures, except those of large entities; both say the same."""
    rows = [(e, m) for e in range(30) for m in range(e, e + 5)] + [(99, m) for m in range(200)]
    baskets = spark.createDataFrame(rows, "item_id bigint, user_id bigint")
    plain = minhash_signatures(baskets, "item_id", "user_id")
    assert "REPARTITION_BY_COL" in plain._jdf.queryExecution().toString()
    expected = {r["item_id"]: (r["n_members"], r["signature"]) for r in plain.collect()}
    by_hand = [min((m * a + b) % PRIME for m in range(200)) for a, b in coefficients()]
    assert expected[99] == (200, by_hand) and expected[3][0] == 5
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)
    assert {r["item_id"]: (r["n_members"], r["signature"]) for r in minhash_signatures(baskets, "item_id", "user_id").collect()} == expected


def test_found_pairs_are_compared_before_they_are_shuffled(spark, monkeypatch):
    """Of many found pairs only those with the hash of an exact one are left, whatever the ids' type; the recall is the same."""
    exact = spark.range(40).select(F.col("id").alias("a"), (F.col("id") * 3 + 100).alias("b"))
    found = spark.range(200).select(F.explode(F.sequence(F.lit(100), F.lit(219))).alias("b"), (F.col("id") % 50).cast("int").alias("a")).where("a % 4 > 0").distinct()
    want = (30, 40, 0.75)
    written = exact.localCheckpoint()
    assert 30 <= evaluate.likely_hits(found, written, "a", "b").count() < 60 < found.count()
    plan = evaluate.likely_hits(found, written, "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [") < plan.index("Join LeftSemi")
    assert tuple(evaluate.recall(found, exact, "a", "b").first()) == want
    monkeypatch.setattr(evaluate, "MOST_PAIRS", 39)
    assert evaluate.likely_hits(found, written, "a", "b").count() == found.count()
    assert tuple(evaluate.recall(found, exact, "a", "b").first()) == want


def test_models_of_the_same_pairs_make_them_once(spark, rated, monkeypatch):
    from kindred.plans import catalog

    ratings = rated(brute.random_ratings(31, users=60, items=30, per_user=8))
    want = [catalog.S.item_jaccard(ratings, lsh=lsh).collect() for lsh in (True, False)]
    scored = catalog.S.scored_items(ratings)
    assert [sorted(catalog.S.item_jaccard(ratings, lsh=lsh, scored=scored).collect()) for lsh in (True, False)] == [sorted(rows) for rows in want]
    made, plain = [], catalog.S.jaccard_pairs
    monkeypatch.setattr(catalog.S, "jaccard_pairs", lambda *a: made.append(a) or plain(*a))
    monkeypatch.setattr(catalog, "_ratings", lambda *_: ratings)
    found = catalog.lsh_confirmed_recall(spark, "").first()
    assert len(made) == 1 and (found["n_found"], found["n_exact"]) == tuple(map(len, want))


def test_only_members_left_out_are_looked_up(spark, rated, monkeypatch):
    """Whole baskets are not fetched for pairs that may pass; the overlaps are those of the whole baskets."""
    monkeypatch.setattr(S, "shared_by", lambda *a: pytest.fail("whole baskets are fetched"))
    rows = [(u, i, 1.0) for i in range(25) for u in range(40) if (u * 7 + i * i) % 40 < 14 + i % 3]
    baskets = {i: {u for u, j, _ in rows if j == i} for i in range(25)}
    want = {(a, b): len(baskets[a] & baskets[b]) for a, b in combinations(range(25), 2)}
    want = {p: n for p, n in want.items() if n / (len(baskets[p[0]] | baskets[p[1]])) > 0.3}
    found = S.jaccard_pairs(rated(rows).select("item_id", "user_id"), "item_id", "user_id", 0.3)
    assert {(r["a"], r["b"]): r["overlap"] for r in found.collect()} == want and want
