"""Similarity measures of two sketches as column expressions.

``j`` is a Jaccard estimate, ``a`` and ``b`` are cardinalities. Nulls give null.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Measure(str, Enum):
    SIMILARITY = "similarity"
    CONTAINMENT = "containment"
    SYMMETRIC_CONTAINMENT = "symmetric_containment"
    MASH_DISTANCE = "mash_distance"
    INTERSECTION = "intersection"
    UNION = "union"
    EDIT_DISTANCE = "edit_distance"

    @property
    def symmetric(self) -> bool:
        return self is not Measure.CONTAINMENT

    @property
    def is_distance(self) -> bool:
        return self in (Measure.MASH_DISTANCE, Measure.EDIT_DISTANCE)


def equal_registers(x: Column, y: Column) -> Column:
    """Registers in which two arrays agree; empty (null) registers agree with nothing."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)


def similarity(equal: Column, size: Column | int) -> Column:
    """Share of equal registers; what rounds to 0 is 0."""
    j = equal / (size if isinstance(size, Column) else F.lit(float(size)))
    return F.when(j <= 1e-15, 0.0).otherwise(j)


def union_size(alpha: Column, beta: Column, a: Column, b: Column) -> Column:
    """From the shares of greater and smaller registers; disjoint sketches give a + b."""
    return F.when(alpha + beta >= 1, a + b).otherwise(F.greatest((a + b) / (2 - alpha - beta), F.lit(0.0)))


def intersection(j: Column, a: Column, b: Column) -> Column:
    return j * (a + b) / (1 + j)


def union(j: Column, a: Column, b: Column) -> Column:
    return a + b - intersection(j, a, b)


def containment(j: Column, a: Column, b: Column) -> Column:
    """How much of the left side lies in the right one; an empty left side gives 0."""
    return F.when(a > 0, intersection(j, a, b) / a).otherwise(0.0)


def symmetric_containment(j: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, intersection(j, a, b) / F.least(a, b)).otherwise(0.0)


def mash_distance(j: Column, k: int) -> Column:
    """Poisson mutation distance of k-mer sets; nothing shared is infinitely far."""
    return F.when(j > 0, F.log((1 + j) / (2 * j)) / F.lit(float(max(k, 1)))).otherwise(F.lit(float("inf")))


def compressed_share(x: Column, base: float) -> Column:
    """Share of registers corrected for quantisation with the given base."""
    return (1 - F.pow(F.lit(base), -x)) / F.lit(1 - 1 / base)


def compressed_similarity(alpha: Column, beta: Column, a: Column, b: Column, base: float) -> Column:
    """Jaccard from greater and smaller shares of quantised registers."""
    ga, gb = compressed_share(alpha, base), compressed_share(beta, base)
    u = F.when(ga + gb >= 1, a + b).otherwise((a + b) / (2 - ga - gb))
    return F.when(u > 0, F.greatest(a + b - u, F.lit(0.0)) / u).otherwise(0.0)


def bbit_similarity(equal_share: Column, bits: float) -> Column:
    """Jaccard from b-bit signatures, corrected for chance agreement."""
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (equal_share - chance) / (1 - chance))


def containment_index(shared: Column, alpha: Column) -> Column:
    return F.when(alpha + shared > 0, shared / (alpha + shared)).otherwise(0.0)


def discrete_ml_similarity(alpha: Column, beta: Column, a: Column, b: Column) -> Column:
    """Closed-form maximum-likelihood Jaccard of two set sketches of known sizes."""
    u, v = a / (a + b), b / (a + b)
    c = u * u * (1 - alpha) + v * v * (1 - beta)
    root = F.sqrt(F.greatest(c * c - 4 * u * u * v * v * (1 - alpha - beta), F.lit(0.0)))
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), F.least((c - root) / (2 * u * v), u / v, v / u))).otherwise(0.0)


def measure(kind: Measure, j: Column, a: Column, b: Column, k: int = 1) -> Column:
    """One measure by name. Edit distance is no function of a sketch and is rejected."""
    if kind is Measure.SIMILARITY:
        return j
    if kind is Measure.MASH_DISTANCE:
        return mash_distance(j, k)
    table = {Measure.CONTAINMENT: containment, Measure.SYMMETRIC_CONTAINMENT: symmetric_containment, Measure.INTERSECTION: intersection, Measure.UNION: union}
    if kind not in table:
        raise ValueError(f"{kind.value} is not defined on sketches")
    return table[kind](j, a, b)
