"""Hash families used for MinHash and for reproducible sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.defaults import HASH_SEED, NUM_HASHES

# The Mersenne prime 2^31 - 1: for x < p the product a * x stays below 2^62.
PRIME = 2_147_483_647


def coefficients(hashes: int = NUM_HASHES, seed: int = HASH_SEED, prime: int = PRIME) -> list[tuple[int, int]]:
    """Pairs (a, b) of the family h(x) = (a x + b) mod p, with a never 0."""
    draw = random.Random(seed)
    return [(draw.randint(1, prime - 1), draw.randint(0, prime - 1)) for _ in range(hashes)]


def linear_hash(x: Column, a: int, b: int, prime: int = PRIME) -> Column:
    return (F.pmod(x, F.lit(prime)) * F.lit(a) + F.lit(b)) % F.lit(prime)


def mix(left: Column, right: Column) -> Column:
    """Integer mix of two numeric ids into [0, 1000003).

    Multiplications modulo a prime with shifts and exclusive ors between them, which break up the arithmetic
    progressions that ids often are. Plain integer arithmetic, so that any SQL engine can repeat it (``mix_sql``);
    string ids are hashed to numbers first.
    """
    h = (F.pmod(left, F.lit(PRIME)) * F.lit(48_271) + F.pmod(right, F.lit(PRIME)) * F.lit(69_621) + F.lit(12_345)) % F.lit(PRIME)
    h = h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(1_103_515_245) % F.lit(PRIME)
    h = h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(48_271) % F.lit(PRIME)
    return h % F.lit(MIX_RANGE)


def mix_sql(left: str, right: str) -> str:
    """``mix`` as SQL for ids that are not negative."""
    h = f"((({left}) % {PRIME} * 48271::BIGINT + ({right}) % {PRIME} * 69621::BIGINT + 12345) % {PRIME})"
    h = f"(xor({h}, {h} >> 15) * 1103515245 % {PRIME})"
    h = f"(xor({h}, {h} >> 13) * 48271 % {PRIME})"
    return f"({h} % {MIX_RANGE})"


MIX_RANGE = 1_000_003


def numeric_id(column: Column, data_type: str) -> Column:
    """The id itself if it is integral, else a 64-bit hash of it."""
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        return column.cast("bigint")
    return F.xxhash64(column)
