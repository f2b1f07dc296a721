"""Similarity and prediction formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A spread below this share of the sum of squares is rounding noise of the moment sums, not variance.
MIN_SPREAD = 1e-9


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from moment sums; NULL where one side does not vary.

    ``corr`` is not used because it divides by zero, and so fails in ANSI mode, on constant groups.
    """
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    varies = (vx > MIN_SPREAD * n * sxx) & (vy > MIN_SPREAD * n * syy)
    r = (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))
    return F.when(varies, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), 6))


def jaccard(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """|A and B| / |A or B| from the overlap and the two set sizes."""
    return overlap / (n_a + n_b - overlap)


def set_cosine(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """|A and B| / sqrt(|A| |B|)."""
    return overlap / F.sqrt((n_a * n_b).cast("double"))


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate sum(w * v) / sum(w); NULL where the weights add up to nothing."""
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def dot(v: Column, w: Column) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(v: Column, w: Column) -> Column:
    """Dense cosine of two arrays of doubles; NULL for a zero vector."""
    return F.try_divide(dot(v, w), F.sqrt(dot(v, v)) * F.sqrt(dot(w, w)))
