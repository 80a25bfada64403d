"""Counting and exact structures per entity; all aggregate with map-side combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60


def counts(features: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """``[entity, <item>, cnt]``: occurrences, or the sum of weights."""
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return features.groupBy("entity", item).agg(agg.alias("cnt"))


def count_sketch(features: DataFrame, item: str, cells: int, weight: str | None = None) -> DataFrame:
    """``[entity, cell, v]``: signed counts; cell and sign come from one hash."""
    h = h60(F.col(item))
    w = F.col(weight) if weight else F.lit(1)
    signed = F.when(F.shiftright(h, 40) % 2 == 1, w).otherwise(-w)
    return features.groupBy("entity", F.pmod(h, F.lit(cells)).cast("int").alias("cell")).agg(F.sum(signed).alias("v"))


def merge_counts(*frames: DataFrame, item: str) -> DataFrame:
    """Counts of several runs added up; items of either side stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("entity", item).agg(F.sum("cnt").alias("cnt"))


def exact_sets(features: DataFrame, item: str) -> DataFrame:
    return features.select("entity", item).distinct()


def cardinality(features: DataFrame, item: str) -> DataFrame:
    """``[entity, card]``: exact distinct count."""
    return features.groupBy("entity").agg(F.countDistinct(item).alias("card"))


def totals(features: DataFrame, weight: str) -> DataFrame:
    """``[entity, total_weight, updates]``."""
    return features.groupBy("entity").agg(F.sum(weight).alias("total_weight"), F.count(F.lit(1)).alias("updates"))


def bottom_k(items: DataFrame, item: str, k: int, weight: str | None = None) -> DataFrame:
    """``[entity, <item>, h]``: the k items of smallest hash (divided by their weight, where
    given); entities with fewer items keep them all. Ties go to the smaller item."""
    h = h60(F.col(item))
    score = h / F.col(weight) if weight else h
    r = F.row_number().over(Window.partitionBy("entity").orderBy("h", item))
    return items.withColumn("h", score).withColumn("_r", r).where(F.col("_r") <= k).select("entity", item, "h")
