"""Pair similarities: Pearson over co-rated values, and Jaccard of baskets.

The functions are symmetric in users and items: ``key`` is what two members share (users, when items
are compared) and ``member`` is what is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.defaults import MIN_CO_RATED, MIN_JACCARD_ITEMS, MIN_JACCARD_USERS, NUM_HASHES, SEARCH_RECALL
from kindred.functions.scores import jaccard, pearson
from kindred.operators.minhash import BandPlan, bucket_pairs, keep_banded, lsh_buckets, lsh_candidates, minhash_signatures, plan_bands
from kindred.operators.pairs import attach, counted_pairs, exact_pairs, shared_by, with_marks
from kindred.session import materialize

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def busiest_keys(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``(key, slot)`` of the ``count`` keys with the most rows; never more than ``count`` rows."""
    top = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(count)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(key)))).alias("keys"))
    return ordered.select(F.posexplode("keys").alias("slot", "entry")).select(F.col(f"entry.{key}").alias(key), "slot")


def co_rating_counts(ratings: DataFrame, key: str, member: str, min_support: int = MIN_CO_RATED) -> DataFrame:
    """``(a, b, n)``: how many keys the members of a pair share, for n >= ``min_support``.

    A pair with support m shares at least one key outside any set of m - 1 keys. The m - 1 busiest keys (at most 62)
    are therefore not paired through: their pairs would be the most, and add no pair that the other keys do not
    find. Each member carries a bit mask of those it has, and a pair's common bits are added to its count. The result
    is exact.
    """
    rows = ratings.select(key, member)
    held = min(max(min_support - 1, 0), 62)
    if not held:
        return counted_pairs(rows, key, member).where(F.col("n") >= min_support).select("a", "b", "n")
    busy = F.broadcast(busiest_keys(rows, key, held))  # at most ``held`` rows
    bits = rows.join(busy, key).groupBy(member).agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("mask"))
    masked = with_marks(rows.join(busy.select(key), key, "left_anti"), bits, [member], key).withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint")))
    n = F.col("n") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))
    return counted_pairs(masked, key, member, ["mask"]).select("a", "b", n.alias("n")).where(F.col("n") >= min_support)


def list_sizes(rows: DataFrame, member: str) -> DataFrame:
    return rows.groupBy(member).agg(F.count(F.lit(1)).alias("size"))


def with_sizes(pairs: DataFrame, sizes: DataFrame, member: str) -> DataFrame:
    """Pairs ``(a, b, ...)`` with ``size_a`` and ``size_b`` from ``(member, size)``."""
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col(member).alias(side), F.col("size").alias(f"size_{side}")), side)
    return pairs


def shared_moments(sized: DataFrame, ratings: DataFrame, key: str, member: str) -> DataFrame:
    """Count and moment sums of the keys that the members of each pair ``(a, b, size_a, size_b)`` share, if any."""
    x, y = F.col("x_a"), F.col("x_b")
    met = shared_by(sized, ratings.select(member, key, F.col("rating").alias("x")), member, ["x"])
    return met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )


def co_rated_moments(
    ratings: DataFrame,
    key: str,
    member: str,
    min_support: int = MIN_CO_RATED,
    min_jaccard: float = 0.0,
) -> DataFrame:
    """Count, moment sums and list sizes (``size_a``, ``size_b``) of pairs that share >= ``min_support`` keys.

    First the pairs are found by count alone; those that fall short of ``min_jaccard`` go. Only for the pairs that
    remain are ratings fetched and summed. The result is exact.
    """
    found = co_rating_counts(ratings, key, member, min_support)
    sizes = list_sizes(ratings, member)
    found = with_sizes(materialize(found, "co-rated"), sizes, member)
    if min_jaccard > 0:
        found = found.where(jaccard(F.col("n"), F.col("size_a"), F.col("size_b")) >= min_jaccard)
    found = materialize(found.drop("n"), "co-rated-sized")
    return shared_moments(found, ratings, key, member).join(found, ["a", "b"])


def with_pearson(moments: DataFrame) -> DataFrame:
    """Pairs with a positive, defined correlation: ``(a, b, n, size_a, size_b, sim)``."""
    score = pearson(*[F.col(m) for m in MOMENTS])
    return moments.select("a", "b", "n", "size_a", "size_b", score.alias("sim")).where(F.col("sim") > 0)


def item_similarity(ratings: DataFrame, min_support: int = MIN_CO_RATED) -> DataFrame:
    """Item-item Pearson model ``(b1, b2, sim)``, b1 < b2."""
    model = with_pearson(co_rated_moments(ratings, "user_id", "item_id", min_support))
    return model.select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim")


def lsh_co_raters(
    ratings: DataFrame,
    key: str,
    member: str,
    min_support: int = MIN_CO_RATED,
    rows: int = 1,
    **hash_options,
) -> DataFrame:
    """Pairs ``(a, b)`` that share an LSH band and at least ``min_support`` keys, each once.

    For wide bands, whose buckets hold nearly all pairs: the co-rating join finds the pairs that a model with that
    support can keep, and the signatures only confirm the band. ``minhash.lsh_candidates`` is the search.
    """
    counts = co_rating_counts(ratings, key, member, min_support)
    signatures = minhash_signatures(ratings.select(member, key), member, key, **hash_options)
    return keep_banded(counts.select("a", "b"), signatures, member, rows)


def searched_pairs(baskets: DataFrame, entity: str, member: str, similarity: float, recall: float, plan: BandPlan | None, **hash_options) -> DataFrame | None:
    """Pairs ``(a, b, size_a, size_b)`` that LSH finds, or None where a search would not pay.

    Without a ``plan`` its bands follow from the recall wanted at the least similarity (``minhash.plan_bands``). The search
    does not pay if the signatures are too short for that recall, or if the members of its buckets make at least
    half as many pairs as an exact join.
    """
    wanted = plan or plan_bands(similarity, recall, hash_options.get("hashes", NUM_HASHES))
    if wanted is None:
        return None
    profiles = minhash_signatures(baskets, entity, member, **hash_options)
    profiles = materialize(profiles.withColumn("signature", F.slice("signature", 1, wanted.rows * wanted.bands)), "signatures")
    if plan is None and 2 * bucket_pairs(lsh_buckets(profiles, entity, wanted.rows)) >= exact_pairs(baskets, member):
        return None
    sizes = profiles.select(entity, F.col("n_members").alias("size"))
    found = with_sizes(lsh_candidates(profiles, entity, wanted.rows), sizes, entity)
    return found.where(F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b"))


def user_similarity_search(
    ratings: DataFrame,
    plan: BandPlan | None = None,
    min_support: int = MIN_CO_RATED,
    min_jaccard: float = MIN_JACCARD_USERS,
    recall: float = SEARCH_RECALL,
    **hash_options,
) -> DataFrame:
    """The user model ``(u1, u2, sim)`` over the pairs that LSH finds; no other pair is ever made.

    Bands are chosen for the ``recall`` wanted of pairs at ``min_jaccard``. Where no search can have it for less
    than the exact model costs, the result is the exact model. A ``plan`` given is carried out, whatever it finds.
    """
    found = searched_pairs(ratings.select("user_id", "item_id"), "user_id", "item_id", min_jaccard, recall, plan, **hash_options)
    if found is None:
        return user_similarity(ratings, min_support, min_jaccard, lsh=False)
    found = materialize(found, "searched-pairs")
    moments = shared_moments(found, ratings, "item_id", "user_id").where(F.col("n") >= min_support)
    scored = with_pearson(moments.join(found, ["a", "b"]))
    kept = scored.where(jaccard(F.col("n"), F.col("size_a"), F.col("size_b")) >= min_jaccard)
    return kept.select(F.col("a").alias("u1"), F.col("b").alias("u2"), "sim")


def item_jaccard_search(
    ratings: DataFrame, plan: BandPlan | None = None, threshold: float = MIN_JACCARD_ITEMS, recall: float = SEARCH_RECALL, **hash_options
) -> DataFrame:
    """Item pairs ``(b1, b2, sim)`` with J > ``threshold`` among those that LSH finds; see ``user_similarity_search``."""
    basket = ratings.select("item_id", "user_id").distinct()
    found = searched_pairs(basket, "item_id", "user_id", threshold, recall, plan, **hash_options)
    if found is None:
        return item_jaccard(ratings, threshold, lsh=False)
    found = materialize(found, "searched-pairs")
    shared = shared_by(found, basket, "item_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    scored = shared.join(found, ["a", "b"]).withColumn("jaccard", jaccard(F.col("overlap"), F.col("size_a"), F.col("size_b")))
    kept = scored.where(F.col("jaccard") > threshold)
    return kept.select(F.col("a").alias("b1"), F.col("b").alias("b2"), F.round("jaccard", 6).alias("sim"))


def user_similarity(
    ratings: DataFrame,
    min_support: int = MIN_CO_RATED,
    min_jaccard: float = MIN_JACCARD_USERS,
    rows: int = 1,
    lsh: bool = True,
    **hash_options,
) -> DataFrame:
    """User-user Pearson model ``(u1, u2, sim)``, u1 < u2.

    A pair must share an LSH band (unless ``lsh`` is off), have ``min_support`` co-rated items and
    Jaccard >= ``min_jaccard``, and correlate positively. Co-ratings are counted first and the
    signatures are looked up for the few pairs left; the result is that of joining the buckets first.
    """
    scored = with_pearson(co_rated_moments(ratings, "item_id", "user_id", min_support, min_jaccard))
    kept = scored.where(jaccard(F.col("n"), F.col("size_a"), F.col("size_b")) >= min_jaccard)
    if lsh:
        profiles = minhash_signatures(ratings.select("user_id", "item_id"), "user_id", "item_id", **hash_options)
        kept = keep_banded(kept, profiles, "user_id", rows)
    return kept.select(F.col("a").alias("u1"), F.col("b").alias("u2"), "sim")


def cut_baskets(baskets: DataFrame, entity: str, member: str, threshold: float) -> DataFrame:
    """``(entity, member, size, dropped, kept)``: all members, of which an index keeps the rarer ones: not as many of the most frequent as can be spared.

    A pair with J > t shares more than t * size members of either basket. Members have one order, by frequency in quarters
    of a power of two and then by hash. If a basket leaves out its last members in that order, at most t * size of
    them, the first member that a similar pair shares is still in both. Where a basket is cut follows from a histogram of
    its places in the order (at most 64 a quarter), so no basket is sorted or held whole.
    """
    rows = baskets.select(entity, member)
    frequency = materialize(rows.groupBy(member).agg(F.count(F.lit(1)).alias("n")), "frequencies")
    total = frequency.agg(F.sum("n")).first()[0] or 0
    place = (F.floor(4 * F.log2("n")) * 64 + F.pmod(F.xxhash64(member), F.lit(64))).cast("int")
    placed = materialize(attach(rows, frequency.select(member, "n", place.alias("place")), member, "n", total).drop("n"), "placed-members")
    # From the most frequent place down, a place is left out as long as all of it can be spared.
    start = F.struct(F.lit(2**31 - 1).alias("cut"), F.lit(0).cast("bigint").alias("dropped"), F.lit(True).alias("open"))

    def step(state: Column, at: Column) -> Column:
        spared = state["open"] & (state["dropped"] + at["held"] <= F.col("spare"))
        return F.struct(
            F.when(spared, at["place"]).otherwise(state["cut"]).alias("cut"),
            F.when(spared, state["dropped"] + at["held"]).otherwise(state["dropped"]).alias("dropped"),
            spared.alias("open"),
        )

    held = placed.groupBy(entity, "place").agg(F.count(F.lit(1)).alias("held"))
    cuts = held.groupBy(entity).agg(F.sum("held").alias("size"), F.sort_array(F.collect_list(F.struct("place", "held")), asc=False).alias("places"))
    cuts = cuts.withColumn("spare", F.floor(F.lit(threshold) * F.col("size") - 1e-9)).select(entity, "size", F.aggregate("places", start, step).alias("end"))
    cuts = materialize(cuts.select(entity, "size", "end.cut", "end.dropped"), "prefix-cuts")
    return attach(placed, cuts, entity, "size", total).select(entity, member, "size", "dropped", (F.col("place") < F.col("cut")).alias("kept"))


def prefix_index(baskets: DataFrame, entity: str, member: str, threshold: float) -> DataFrame:
    """``(entity, member, size, dropped)``: the members that the index keeps."""
    return cut_baskets(baskets, entity, member, threshold).where("kept").drop("kept")


def jaccard_pairs(baskets: DataFrame, entity: str, member: str, threshold: float) -> DataFrame:
    """All pairs ``(a, b, overlap, jaccard)`` with Jaccard > ``threshold`` (exact).

    Baskets are paired through the rarer members that a prefix index keeps of them, if their sizes allow the threshold. What
    a pair may share besides is bounded by what the index left out; only for pairs that can still pass are the members left out of
    one basket looked up in the other, which are fewer than the shorter basket has.
    """
    cut = materialize(cut_baskets(baskets.select(entity, member), entity, member, threshold), "cut-baskets")
    kept, spared = cut.where("kept").drop("kept"), cut.where(~F.col("kept"))
    sizes_allow = F.least("size_a", "size_b") > F.lit(threshold) * F.greatest("size_a", "size_b")
    met = counted_pairs(kept, member, entity, ["size", "dropped"], keep=sizes_allow)
    missed = F.greatest("dropped_a", "dropped_b")
    possible = F.least(F.col("n") + missed, F.col("size_a"), F.col("size_b"))
    met = materialize(met.where(jaccard(possible, F.col("size_a"), F.col("size_b")) > threshold), "similar-baskets")
    pair = ["a", "b", "size_a", "size_b", "n"]

    def further(own: str, other: str, members: DataFrame) -> DataFrame:
        """A row for each member left out of one basket that is among ``members`` of the other."""
        out = spared.select(F.col(entity).alias(own), F.col(member).alias("__m"))
        there = members.select(F.col(entity).alias(other), F.col(member).alias("__m"))
        return met.where(F.col(f"dropped_{own}") > 0).select(*pair).join(out, own).join(there, [other, "__m"]).select(*pair, F.lit(1).alias("more"))

    # A member left out of both is counted on one side. Pairs that pass as they are need no further one.
    passed = met.where(jaccard(F.col("n"), F.col("size_a"), F.col("size_b")) > threshold).select(*pair, F.lit(0).alias("more"))
    counted = passed.unionByName(further("a", "b", cut)).unionByName(further("b", "a", kept)).groupBy(*pair).agg((F.col("n") + F.sum("more")).alias("overlap"))
    return (
        counted.withColumn("jaccard", jaccard(F.col("overlap"), F.col("size_a"), F.col("size_b")))
        .where(F.col("jaccard") > threshold)
        .select("a", "b", "overlap", "jaccard")
    )


def scored_items(ratings: DataFrame, threshold: float = MIN_JACCARD_ITEMS) -> DataFrame:
    """All item pairs ``(a, b, overlap, jaccard)`` with J > ``threshold``."""
    # Written, as pairs read it several times and would make it distinct each time.
    return jaccard_pairs(materialize(ratings.select("item_id", "user_id").distinct(), "item-baskets"), "item_id", "user_id", threshold)


def item_jaccard(
    ratings: DataFrame,
    threshold: float = MIN_JACCARD_ITEMS,
    rows: int = 1,
    lsh: bool = True,
    scored: DataFrame | None = None,
    **hash_options,
) -> DataFrame:
    """Item-item Jaccard model ``(b1, b2, sim)`` of the pairs with J > ``threshold`` that share an LSH band.

    With ``lsh`` off, of all pairs with J > ``threshold``. ``scored`` are the written pairs of ``scored_items``, for several models of the same ratings.
    """
    basket = materialize(ratings.select("item_id", "user_id").distinct(), "item-baskets") if scored is None or lsh else None
    scored = jaccard_pairs(basket, "item_id", "user_id", threshold) if scored is None else scored
    if lsh:
        scored = keep_banded(scored, minhash_signatures(basket, "item_id", "user_id", **hash_options), "item_id", rows)
    return scored.select(F.col("a").alias("b1"), F.col("b").alias("b2"), F.round("jaccard", 6).alias("sim"))
