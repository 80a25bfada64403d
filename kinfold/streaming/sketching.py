"""Sketches, containment and candidate search over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60
from ..operators import neighbours as N


def stream_oph(stream: DataFrame, entity: str, item: str, size: int) -> DataFrame:
    """One-permutation registers of an unbounded stream, for update mode; the state holds
    at most ``size`` rows per entity."""
    h = stream.where(F.col(item).isNotNull()).select(F.col(entity).alias("entity"), h60(F.col(item)).alias("h"))
    return h.groupBy("entity", F.pmod("h", F.lit(size)).cast("int").alias("reg")).agg(F.min("h").alias("v"))


def windowed_oph(stream: DataFrame, ts: str, item: str, size: int, length: str, late: str, entity: str | None = None) -> DataFrame:
    """Registers per time window; rows later than the watermark are dropped by Spark and a
    window's state goes with it."""
    src = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).where(F.col(item).isNotNull())
    keys = [F.window("_ts", length).alias("window")] + ([F.col(entity).alias("entity")] if entity else [])
    h = h60(F.col(item))
    return src.groupBy(*keys, F.pmod(h, F.lit(size)).cast("int").alias("reg")).agg(F.min(h).alias("v"))


def stream_containment(stream: DataFrame, db: DataFrame, item: str) -> DataFrame:
    """Hits per (query, ref, item) of a feature stream ``[entity, <item>]`` against a static
    database ``[ref, <item>]``; ``coverage`` reduces them."""
    met = stream.join(db.select("ref", item).distinct(), item)
    return met.groupBy(F.col("entity").alias("query"), "ref", item).agg(F.count(F.lit(1)).alias("n"))


def coverage(hits: DataFrame, db: DataFrame, item: str) -> DataFrame:
    size = db.groupBy("ref").agg(F.countDistinct(item).alias("total"))
    agg = hits.groupBy("query", "ref").agg(F.count(F.lit(1)).alias("hit"), F.sum("n").alias("depth"))
    return agg.join(size, "ref").select("query", "ref", (F.col("hit") / F.col("total")).alias("coverage"), (F.col("depth") / F.col("hit")).alias("mean_depth"))


def online_candidates(index_path: str, out_path: str, size: int, levels: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: look the batch's registers ``[entity, reg, v]`` up in the
    index table and among themselves, write candidates, then append to the index. The index
    is a table, not state. A batch that is run again overwrites its own parts."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = N.band_keys(batch, size, levels).persist()
        part = f"{index_path}/batch={number}"
        from pyspark.errors import AnalysisException

        known = keys
        try:
            known = spark.read.parquet(index_path).where(F.col("batch") < number).drop("batch").unionByName(keys)
        except AnalysisException:
            pass
        N.candidates(known, keys).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        keys.write.mode("overwrite").parquet(part)
        keys.unpersist()

    return step
