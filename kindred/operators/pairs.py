"""Building blocks for pair work: self-joins inside a key, and intersections of two neighbour lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import materialize

# A key with more rows than this is cut into blocks, so one task sees at most BLOCK_ROWS^2 pairs of it.
BLOCK_ROWS = 2048
# Members with more than this share of all rows are hot. There are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4
# Pairs that one task should count; a task takes about 270 bytes for each.
PAIRS_PER_TASK = 1_000_000
# Places over which the rows of a marked key are spread when they meet its mark.
SALTS = 16


def with_marks(rows: DataFrame, marks: DataFrame, key: Sequence[str], spread_by: str) -> DataFrame:
    """``rows`` left-joined with ``marks`` (one row for some keys); the rows of a key meet its mark in several places."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(marks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "__salt"], "left").drop("__salt")


def pairs_within(
    rows: DataFrame,
    key: Sequence[str],
    member: str,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs a < b of members that share a key, each once per shared key.

    Columns: the key, ``a``, ``b`` and ``<c>_a``, ``<c>_b`` for each carried column. Members are unique
    per key. A large key is cut into blocks by a hash of the member and its block pairs (i <= j) become
    separate join keys, which spreads one hot key over many tasks.
    """
    key = list(key)
    large = (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > block_rows)
        .select(*key, F.ceil(F.col("__n") / block_rows).cast("int").alias("__blocks"))
    )
    tagged = (
        with_marks(rows.select(*key, member, *carry), large, key, member)
        .withColumn("__last", F.coalesce(F.col("__blocks"), F.lit(1)) - 1)
        .withColumn("__own", F.pmod(F.xxhash64(member), F.col("__last") + 1).cast("int"))
    )

    def side(suffix: str, own: str, other: str, cells) -> DataFrame:
        return tagged.select(
            *key,
            F.col("__own").alias(own),
            F.explode(cells).alias(other),
            F.col(member).alias(f"__m_{suffix}"),
            *[F.col(c).alias(f"__{c}_{suffix}") for c in carry],
        )

    low = side("l", "__i", "__j", F.sequence("__own", "__last"))
    high = side("r", "__j", "__i", F.sequence(F.lit(0), F.col("__own")))
    joined = low.join(high, [*key, "__i", "__j"]).where(
        (F.col("__i") < F.col("__j")) | (F.col("__m_l") < F.col("__m_r"))
    )
    in_order = F.col("__m_l") < F.col("__m_r")

    def ordered(name: str, a: str, b: str) -> list:
        left, right = F.col(f"__{name}_l"), F.col(f"__{name}_r")
        return [
            F.when(in_order, left).otherwise(right).alias(a),
            F.when(in_order, right).otherwise(left).alias(b),
        ]

    columns = ordered("m", "a", "b")
    for c in carry:
        columns += ordered(c, f"{c}_a", f"{c}_b")
    # Members differ within a key, so off-diagonal blocks never hold a pair of equals.
    return joined.select(*key, *columns)


def exact_pairs(rows: DataFrame, key: str) -> int:
    """How many pairs a join of ``rows`` with itself on ``key`` makes."""
    n = F.count(F.lit(1)).cast("double")
    return int(rows.groupBy(key).agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0)


def attach(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``values`` that each key has; ``size`` counts the key's rows among ``total``.

    Keys with more than HOT_SHARE of all rows, at most 1 / HOT_SHARE of them, go to where their rows are. Of the others, a task
    holds its share in a hash table, so that rows are not sorted.
    """
    frequent = F.col(size) > max(BLOCK_ROWS, total * HOT_SHARE)
    if not values.where(frequent).head(1):
        return rows.join(values.hint("shuffle_hash"), key)
    hot = F.broadcast(values.where(frequent))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(values.where(~frequent).hint("shuffle_hash"), key))


def shared_by(pairs: DataFrame, rows: DataFrame, member: str, carry: Sequence[str] = ()) -> DataFrame:
    """The keys that both members of each pair ``(a, b, size_a, size_b)`` have: ``(a, b, <key>, <c>_a, <c>_b)``.

    ``rows`` are ``(member, <key>, carry...)``. Each pair expands the shorter of its two lists and looks the other up.
    """
    keys = [c for c in rows.columns if c not in (member, *carry)]
    first = F.col("size_a") <= F.col("size_b")
    turned = pairs.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("__s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("__l"))
    short = rows.select(F.col(member).alias("__s"), *keys, *[F.col(c).alias(f"__s_{c}") for c in carry])
    long = rows.select(F.col(member).alias("__l"), *keys, *[F.col(c).alias(f"__l_{c}") for c in carry])
    met = turned.join(short, "__s").join(long, ["__l", *keys])
    own = F.col("a") == F.col("__s")
    sides = []
    for c in carry:
        sides += [F.when(own, F.col(f"__s_{c}")).otherwise(F.col(f"__l_{c}")).alias(f"{c}_a"), F.when(own, F.col(f"__l_{c}")).otherwise(F.col(f"__s_{c}")).alias(f"{c}_b")]
    return met.select("a", "b", *keys, *sides)


def counted_pairs(
    rows: DataFrame,
    key: str,
    member: str,
    carry: Sequence[str] = (),
    keep: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """``(a, b, n, <c>_a, <c>_b)``: how many keys the members of each pair a < b share, for pairs that ``keep`` lets pass.

    ``rows`` has no duplicates; ``carry`` names properties of the member, and ``keep`` a condition on those of both.

    Pairs travel as lists: the members of a key make one sorted list, and each member takes the rest of it along to
    the task that counts its pairs. So a pair costs the bytes of one member in the shuffle, not a row, and counting
    needs no further one. Lists are cut into blocks as in ``pairs_within``. Members with more than HOT_SHARE of the rows
    are the exception: their pairs are counted where they are made and summed by pair, so no task gets one of them whole.
    """
    carry = list(carry)
    rows = materialize(rows.select(key, member, *carry), "members")
    sizes = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "key-sizes")
    n = F.col("__n").cast("double")
    total, made, most = sizes.agg(F.sum("__n"), F.sum(n * (n - 1) / 2), F.max("__n")).first()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((made or 0) // pairs_per_task))
    hot = rows.groupBy(member).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(block_rows, (total or 0) * HOT_SHARE))
    hot = materialize(hot.select(F.col(member).alias("a")), "hot-members")
    entry = F.struct(F.col(member).alias("m"), *carry)
    if (most or 0) > block_rows:
        large = sizes.where(F.col("__n") > block_rows).select(key, F.ceil(F.col("__n") / block_rows).cast("int").alias("__blocks"))
        tagged = with_marks(rows, large, [key], member).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        tagged = tagged.withColumn("__own", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
        lists = tagged.groupBy(key, "__own", "__blocks").agg(F.sort_array(F.collect_list(entry)).alias("__list"))
        lists = materialize(lists, "member-lists")
    else:
        lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("__list"))

    def stripes(of: DataFrame, first: str, rest: str, sorted_rest: bool) -> DataFrame:
        """(a, <c>_a, b, <c>_b): each member of a list with the larger members of another, as arrays."""
        parts = of.withColumns({f"__r_{c}": F.col(f"{rest}.{c}") for c in ["m", *carry]})
        parts = parts.select(F.posexplode(first).alias("__p", "__x"), *[f"__r_{c}" for c in ["m", *carry]])
        if sorted_rest:  # the list itself: the larger ones are those behind
            start, enough = F.col("__p") + 2, F.size("__r_m") > F.col("__p") + 1
        else:
            start = F.size(F.filter("__r_m", lambda y: y < F.col("__x.m"))) + 1
            enough = F.size("__r_m") >= start
        sides = [(f"{c}_a" if c != "m" else "a", f"{c}_b" if c != "m" else "b", c) for c in ["m", *carry]]
        left = [F.col(f"__x.{c}").alias(a) for a, _, c in sides]
        return parts.where(enough).select(*left, *[F.slice(f"__r_{c}", start, F.size(f"__r_{c}")).alias(b) for _, b, c in sides])

    found = stripes(lists, "__list", "__list", True)
    if (most or 0) > block_rows:
        several = lists.where(F.col("__blocks") > 1)
        low = several.select(key, F.col("__own").alias("__i"), F.explode(F.sequence(F.col("__own") + 1, F.col("__blocks"))).alias("__j"), F.col("__list").alias("__low"))
        high = several.where(F.col("__own") > 0).select(
            key, F.explode(F.sequence(F.lit(0), F.col("__own") - 1)).alias("__i"), F.col("__own").alias("__j"), F.col("__list").alias("__high")
        )
        both = low.join(high, [key, "__i", "__j"])
        found = found.unionByName(stripes(both, "__low", "__high", False)).unionByName(stripes(both, "__high", "__low", False))

    def counted(part: DataFrame) -> DataFrame:
        rows = part.select(
            "a", *[f"{c}_a" for c in carry], F.posexplode("b").alias("__at", "__b"), *[F.col(f"{c}_b").alias(f"__{c}") for c in carry]
        ).select("a", F.col("__b").alias("b"), *[f"{c}_a" for c in carry], *[F.col(f"__{c}")[F.col("__at")].alias(f"{c}_b") for c in carry])
        if keep is not None:
            rows = rows.where(keep)
        return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *[F.first(f"{c}_{side}").alias(f"{c}_{side}") for c in carry for side in "ab"])

    if not hot.head(1):
        return counted(found.repartition(tasks, "a"))
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    found = materialize(found, "stripes")
    rest = counted(found.join(hot, "a", "left_anti").repartition(tasks, "a"))
    return rest.unionByName(counted(found.join(hot, "a", "left_semi")))


def meet(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    via: str,
) -> DataFrame:
    """For each pair, the ``via`` values that both the left and the right key have, with their columns.

    ``pairs(left_key, right_key)`` is intersected with ``left(left_key, via, ...)`` and
    ``right(right_key, via, ...)``. Each pair expands its shorter list and looks the other one up, so a
    key that holds a third of all rows is never the one that is expanded next to a short list.
    """
    left_size = left.groupBy(left_key).agg(F.count(F.lit(1)).alias("__nl"))
    right_size = right.groupBy(right_key).agg(F.count(F.lit(1)).alias("__nr"))
    sized = pairs.join(right_size, right_key).join(left_size, left_key)
    through_left = (
        sized.where(F.col("__nl") <= F.col("__nr")).drop("__nl", "__nr")
        .join(left, left_key)
        .join(right, [right_key, via])
    )
    through_right = (
        sized.where(F.col("__nl") > F.col("__nr")).drop("__nl", "__nr")
        .join(right, right_key)
        .join(left, [left_key, via])
    )
    return through_left.unionByName(through_right)


def symmetrise(model: DataFrame, a: str, b: str, key: str, other: str, carry: Sequence[str] = ("sim",)) -> DataFrame:
    """Both directions of an unordered pair table as ``(key, other, ...)``.

    One scan: each row is exploded into its two directions.
    """
    both = F.array(
        F.struct(F.col(a).alias(key), F.col(b).alias(other)),
        F.struct(F.col(b).alias(key), F.col(a).alias(other)),
    )
    return model.select(F.inline(both), *carry)
