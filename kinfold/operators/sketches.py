"""Mergeable sketches as plain aggregations.

Registers are long frames ``[entity, reg, v]``; a register that no item reached has no
row. Merging sketches is the aggregation once more over the union of their rows. Input
frames are ``[entity, <item>(, <weight>)]``; null items are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import RANGE, h60, u01

#: Parameters (b, a, q) of discrete set sketches by register width.
PRESETS = {
    "nibble": (math.e, 5e-4, 14),
    "byte": (1.2, 20.0, 254),
    "short": (1.0005, 0.06, 65534),
    "uint": (1.0000000109723500835, 19.77882586, 2**32 - 2),
}


def oph(features: DataFrame, item: str, size: int, seed: str | None = None, fast: bool = False, keep: bool = False) -> DataFrame:
    """One-permutation sketch ``[entity, reg, v]``: the smallest hash of each bucket; with
    ``keep`` also the item it belongs to."""
    if size < 1:
        raise ValueError("a sketch needs a register")
    h = features.where(F.col(item).isNotNull()).select("entity", F.col(item).alias("item"), h60(F.col(item), seed, fast).alias("h"))
    aggs = [F.min("h").alias("v")] + ([F.min_by("item", "h").alias("item")] if keep else [])
    return h.groupBy("entity", F.pmod("h", F.lit(size)).cast("int").alias("reg")).agg(*aggs)


def oph_cardinality(regs: DataFrame, size: int) -> DataFrame:
    """``[entity, card]``: S*S / sum of the registers' fractions, empty ones counting 1.
    Biased upwards below about ten items per register; ``cardinality`` counts those."""
    total = F.sum(F.col("v") / RANGE) + (size - F.count(F.lit(1)))
    return regs.groupBy("entity").agg((F.lit(float(size * size)) / total).alias("card"))


def cardinality(features: DataFrame, item: str, size: int) -> DataFrame:
    """``[entity, card]``: the estimate, or the exact count where that is below 10 S. Both
    come from one pass over the distinct items of the small entities only."""
    est = oph_cardinality(oph(features, item, size), size)
    small = est.where(F.col("card") < 10.0 * size * 1.5).select("entity")
    exact = features.where(F.col(item).isNotNull()).join(small, "entity").groupBy("entity").agg(F.countDistinct(item).cast("double").alias("n"))
    return est.join(exact, "entity", "left").select("entity", F.when(F.col("n") < 10 * size, F.col("n")).otherwise(F.col("card")).alias("card"))


def oph_exponential(regs: DataFrame, size: int) -> DataFrame:
    """Registers as exponential values; empty registers would be 0 and have no row."""
    used = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    return regs.select("entity", "reg", (-F.log1p(-F.col("v") / RANGE) / used).alias("v"))


def winners(sampled: DataFrame, features: DataFrame, item: str) -> DataFrame:
    """``[entity, reg, item, cnt]``: how often each register's item occurs in its entity."""
    c = features.groupBy("entity", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    return sampled.join(c, ["entity", "item"]).select("entity", "reg", "item", "cnt")


def densify(regs: DataFrame, size: int) -> DataFrame:
    """Every empty register copies a used one, chosen by a hash of the two numbers only, so
    that all entities choose alike. Entities without any register stay empty."""
    every = regs.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("reg"))
    empty = every.join(regs, ["entity", "reg"], "left_anti")
    rank = h60(F.concat_ws("~", F.col("reg").cast("string"), F.col("donor").cast("string")))
    give = regs.select("entity", F.col("reg").alias("donor"), "v")
    best = empty.join(give, "entity").groupBy("entity", "reg").agg(F.min_by("v", F.struct(rank, F.col("donor"))).alias("v"))
    return regs.select("entity", "reg", "v").unionByName(best)


def setsketch(features: DataFrame, item: str, size: int, seed: str | None = None) -> DataFrame:
    """Full set sketch: register j is the smallest of -ln u(item, j). Size times the work
    of ``oph``; ``setsketch_fast`` draws the same law with early exit."""
    each = features.where(F.col(item).isNotNull()).select("entity", F.col(item).cast("string").alias("x")).distinct()
    each = each.select("entity", "x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("reg"))
    u = u01(h60(F.concat_ws("|", F.col("x"), F.col("reg").cast("string")), seed))
    return each.groupBy("entity", "reg").agg(F.min(-F.log(u)).alias("v"))


def setsketch_fast(features: DataFrame, item: str, size: int) -> DataFrame:
    """Full set sketch by increasing exponential draws: each item visits the registers in
    random order with growing values and stops once no register can be improved. Partial
    sketches are built per partition and merged by minimum."""
    src = features.where(F.col(item).isNotNull()).select("entity", F.xxhash64(item).alias("h"))
    kind = src.schema["entity"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs: dict = {}
            for e, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = regs.get(e)
                if r is None:
                    r = regs[e] = np.full(size, np.inf)
                rng = np.random.default_rng(h & (2**63 - 1))
                perm, step, x = rng.permutation(size), rng.standard_exponential(size), 0.0
                top = r.max()
                for j in range(size):
                    x += step[j] / (size - j)
                    if x >= top:
                        break
                    if x < r[perm[j]]:
                        was = r[perm[j]]
                        r[perm[j]] = x
                        top = r.max() if was == top else top
            ids = [e for e in regs for _ in range(size)]
            v = np.concatenate([*regs.values(), np.zeros(0)])
            ok = np.isfinite(v)
            out = [pa.array(ids, b.schema.field(0).type).filter(pa.array(ok)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(regs))[ok]), pa.array(v[ok])]
            yield pa.RecordBatch.from_arrays(out, ["entity", "reg", "v"])

    return src.mapInArrow(run, f"entity {kind}, reg int, v double").groupBy("entity", "reg").agg(F.min("v").alias("v"))


def setsketch_cardinality(regs: DataFrame, size: int) -> DataFrame:
    return regs.groupBy("entity").agg((F.lit(float(size)) / F.sum("v")).alias("card"))


def merge(regs: DataFrame, into: DataFrame, key: str) -> DataFrame:
    """Union of sketches: entities mapped to groups by ``into [entity, <key>]``."""
    return regs.join(into, "entity").groupBy(F.col(key).alias("entity"), "reg").agg(F.min("v").alias("v"))


def rollup(regs: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Two-level reduction: sketches by (coarse, fine) reduced to coarse by minimum."""
    return regs.groupBy(F.col(coarse).alias("entity"), "reg").agg(F.min("v").alias("v"))


def discretise(regs: DataFrame, b: float, a: float, q: int) -> DataFrame:
    """Discrete set sketch registers from continuous ones (larger is smaller)."""
    k = F.floor(1 - F.log(F.col("v") / a) / math.log(b))
    return regs.select("entity", "reg", F.least(F.greatest(k, F.lit(0)), F.lit(q + 1)).cast("bigint").alias("k"))


def discrete_cardinality(disc: DataFrame, size: int, b: float, a: float) -> DataFrame:
    """From the registers' histogram: S(1-1/b) / (a ln b sum b^-k)."""
    hist = disc.groupBy("entity", "k").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("entity").agg((F.lit(size * (1 - 1 / b) / (a * math.log(b))) / F.sum(F.col("n") * F.pow(F.lit(b), -F.col("k")))).alias("card"))


def best_base(regs: DataFrame, q: int) -> tuple[float, float]:
    """(b, a) that spread the observed registers over q steps."""
    low, high = regs.agg(F.min("v"), F.max("v")).first()
    if low is None or low <= 0 or high <= low:
        return PRESETS["byte"][0], PRESETS["byte"][1]
    b = math.exp(math.log(high / low) / q)
    return b, high / b


def quantise(regs: DataFrame, q: int) -> DataFrame:
    """Registers log-compressed to q + 2 levels with the base fitted to their range."""
    b, a = best_base(regs, q)
    return discretise(regs, b, a, q)


def bbit(regs: DataFrame, bits: int) -> DataFrame:
    """``[entity, reg, sig]``: the top bits of a hash of each (integer) register."""
    return regs.select("entity", "reg", F.shiftright(h60(F.col("v")), 60 - bits).alias("sig"))


def signatures(regs: DataFrame) -> DataFrame:
    """Integer signatures of integer registers."""
    return regs.select("entity", "reg", h60(F.col("v")).alias("sig"))


def bagminhash(features: DataFrame, item: str, weight: str, size: int) -> DataFrame:
    """Weighted (multiset) min-hash: each unit of weight is a replica, and a rest of less
    than a unit is one where a hash of item and replica lies below it, in every entity
    alike; one-permutation registers over the replicas. Collisions follow sum min / sum max
    for real weights; those not above 0 are absent."""
    w = features.where(F.col(item).isNotNull() & (F.col(weight) > 0)).select("entity", F.col(item).cast("string").alias("x"), F.col(weight).cast("double").alias("w"))
    rep = w.select("entity", "w", "x", F.explode(F.sequence(F.lit(1), F.ceil("w").cast("int"))).alias("r"))
    rep = rep.select("entity", "w", "r", F.concat_ws("#", F.col("x"), F.col("r").cast("string")).alias("item"))
    part = u01(h60(F.concat(F.col("item"), F.lit("!")))) <= F.col("w") - (F.col("r") - 1)
    return oph(rep.where((F.col("r") <= F.col("w")) | part), "item", size)


def icws(features: DataFrame, item: str, weight: str, size: int) -> DataFrame:
    """Weighted min-hash for real weights by consistent weighted sampling: ``v`` identifies
    the sampled (item, level); equal with probability sum min / sum max."""
    src = features.where(F.col(item).isNotNull() & (F.col(weight) > 0)).select("entity", F.col(item).cast("string").alias("x"), F.col(weight).cast("double").alias("w"))
    src = src.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("reg"))
    u = lambda s: u01(h60(F.concat_ws("|", F.lit(s), F.col("x"), F.col("reg").cast("string"))))
    r, c, beta = -F.log(u("a") * u("b")), -F.log(u("c") * u("d")), u("e")
    src = src.withColumn("r", r).withColumn("c", c).withColumn("beta", beta).withColumn("t", F.floor(F.log("w") / F.col("r") + F.col("beta")))
    score = F.log("c") - (F.col("r") * (F.col("t") - F.col("beta")) + F.col("r"))
    return src.withColumn("s", score).groupBy("entity", "reg").agg(F.min_by(h60(F.concat_ws("|", F.col("x"), F.col("t").cast("string"))), F.struct("s", "x")).alias("v"))


def probminhash(features: DataFrame, item: str, weight: str, size: int) -> DataFrame:
    """Probability min-hash ``[entity, reg, v, item]``: register j holds the item with the
    smallest -ln u(item, j) / weight."""
    src = features.where(F.col(item).isNotNull() & (F.col(weight) > 0)).groupBy("entity", F.col(item).alias("item")).agg(F.sum(weight).alias("w"))
    src = src.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("reg"))
    v = -F.log(u01(h60(F.concat_ws("|", F.col("item").cast("string"), F.col("reg").cast("string"))))) / F.col("w")
    return src.withColumn("v", v).groupBy("entity", "reg").agg(F.min("v").alias("v"), F.min_by("item", F.struct("v", "item")).alias("item"))


def orderminhash(features: DataFrame, item: str, size: int, ell: int = 2) -> DataFrame:
    """Order min-hash of ``[entity, pos, <item>]``: per register the ``ell`` items (with
    their occurrence number) of smallest hash, put back into their order and hashed."""
    occ = F.row_number().over(Window.partitionBy("entity", item).orderBy("pos"))
    src = features.withColumn("x", F.concat_ws("#", F.col(item).cast("string"), occ.cast("string")))
    src = src.select("entity", "pos", F.col(item).cast("string").alias("item"), "x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("reg"))
    src = src.withColumn("h", h60(F.concat_ws("|", F.col("x"), F.col("reg").cast("string"))))
    r = F.row_number().over(Window.partitionBy("entity", "reg").orderBy("h", "x"))
    low = src.withColumn("r", r).where(F.col("r") <= ell)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda e: e["item"]), "|")
    return low.groupBy("entity", "reg").agg(h60(line).alias("v"))


def wide(regs: DataFrame, size: int) -> DataFrame:
    """``[entity, sig]``: registers as an array; empty ones null."""
    m = F.map_from_entries(F.collect_list(F.struct("reg", F.col("v"))))
    return regs.groupBy("entity").agg(m.alias("m")).select("entity", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i.cast("int"))).alias("sig"))
