"""Filters on features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import RANGE, h60


def block(features: DataFrame, blocked: DataFrame, item: str) -> DataFrame:
    """Features that are not in the block list; anti-join, before any aggregation."""
    return features.join(blocked.select(item).distinct(), item, "left_anti").select(*features.columns)


def bloom_block(features: DataFrame, blocked: DataFrame, item: str, bits: int = 1 << 20, hashes: int = 4) -> DataFrame:
    """Features that a Bloom filter of the block list does not hold: all blocked items go,
    and a few others by chance. The filter is a table of its set bits, so its size is
    bounded by ``bits``."""
    spots = lambda c: F.array(*[F.pmod(h60(c, str(i)), F.lit(bits)) for i in range(hashes)])
    held = blocked.select(F.explode(spots(F.col(item))).alias("bit")).distinct()
    asked = features.select(item).distinct().select(item, F.explode(F.array_distinct(spots(F.col(item)))).alias("bit"))
    hit = asked.join(held.withColumn("on", F.lit(1)), "bit", "left").groupBy(item).agg(F.min(F.coalesce("on", F.lit(0))).alias("all"))
    return features.join(hit.where("all = 1").select(item), item, "left_anti").select(*features.columns)


def downsample(features: DataFrame, item: str, fraction: float, seed: str | None = None) -> DataFrame:
    """The features whose hash is below ``fraction`` of its range: the same for every
    entity, whatever the order. 1 keeps all and adds no filter."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must lie in [0, 1]")
    return features if fraction == 1 else features.where(h60(F.col(item), seed) < F.lit(int(fraction * RANGE)))


def min_count(counts: DataFrame, least: float, col: str = "cnt") -> DataFrame:
    """Items counted at least ``least`` times."""
    return counts.where(F.col(col) >= least)


def threshold(pairs: DataFrame, score: str, limit: float, distance: bool = False) -> DataFrame:
    """Pairs at or above a similarity; below a distance."""
    return pairs.where(F.col(score) < limit if distance else F.col(score) >= limit)


def nonzero(pairs: DataFrame, score: str) -> DataFrame:
    return pairs.where(F.col(score) > 0)


def require(df: DataFrame, ok: str, message: str) -> DataFrame:
    """Fail at run time on a row for which the condition does not hold."""
    return df.where(F.when(F.expr(ok), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
