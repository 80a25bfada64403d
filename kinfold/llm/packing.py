"""Containers of fixed capacity filled by vector bin packing.

Each item is a vector (tokens, segments, loss-bearing tokens) and a container limits all
three sums. Items are dealt at random into shards of a bounded number of items; each shard
is packed by the dot-product heuristic: into the open container goes the fitting item whose
normalised vector has the largest dot product with what is left of the container. The
containers of a shard that stayed slack, a few at its end, are opened again and their items
packed across shards in further rounds, until one shard is left or a round saves hardly any
container, as with items that leave every container slack whatever their company.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .components import union_all


def pack_shard(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each row of ``sizes``; every row must fit an empty container.

    Equal vectors are interchangeable, so the search runs over distinct vectors and their
    remaining multiplicity. Ties of the dot product go to the larger vector in the given
    column order.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    kinds, which, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    queue = [list(q) for q in np.split(np.argsort(which, kind="stable"), np.cumsum(left)[:-1])]
    kinds, queue = kinds[::-1], queue[::-1]
    left = left[::-1].copy()
    unit = kinds / limits
    out = np.full(len(sizes), -1, np.int64)
    live = np.arange(len(kinds))
    container, placed = 0, 0
    while placed < len(sizes):
        room = limits.astype(np.int64).copy()
        live = live[left[live] > 0]
        fit = live
        while True:
            fit = fit[(left[fit] > 0) & (kinds[fit] <= room).all(axis=1)]
            if not len(fit):
                break
            best = fit[np.argmax(unit[fit] @ (room / limits))]
            out[queue[best].pop()] = container
            left[best] -= 1
            room -= kinds[best]
            placed += 1
        container += 1
    return out


def pack(
    items: DataFrame,
    id_col: str,
    sizes: Sequence[str],
    limits: Sequence[int],
    shard_items: int = 4000,
    slack: float = 0.02,
    gain: float = 0.01,
) -> DataFrame:
    """``[<id_col>, piece, <sizes>, container_id]``: a container for every item.

    ``sizes`` are the size columns, the first of which may be split: an item that exceeds
    ``limits[0]`` there is cut into full pieces and a rest (pieces are numbered from 0; the
    other sizes are divided in proportion, rounded up, at most their limit). No other item
    is split. Rows whose first size is null or not above 0 need no container and give no
    row; a null further size counts as 0. Repeated ids are separate items. An item that
    exceeds another limit without exceeding the first raises an error. A container filled
    below ``1 - slack`` is opened again; the rounds end when one saves less than the share
    ``gain`` of the containers it opened. Every item is packed in any case.
    """
    first, spark = sizes[0], items.sparkSession
    cap = int(limits[0])
    base = items.select(F.col(id_col).alias("i"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(f"s{n}") for n, c in enumerate(sizes)]).where("s0 > 0")
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("s0") - 1) / cap).cast("int")))).withColumn("all", F.col("s0"))
    cols = [f"s{n}" for n in range(len(sizes))]
    part = F.least(F.lit(cap), F.col("all") - F.col("piece") * cap)
    rest = [
        F.when(F.col("all") <= cap, F.col(c)).otherwise(F.least(F.lit(int(limits[n])), F.ceil(F.col(c) * part / F.col("all")))).cast("bigint").alias(c)
        for n, c in enumerate(cols)
        if n
    ]
    todo = cut(pieces.select("i", F.col("piece").cast("int").alias("piece"), part.cast("bigint").alias("s0"), *rest).withColumn("u", F.monotonically_increasing_id()))
    stats = todo.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in cols]).first()
    for n, c in enumerate(cols):
        if stats["n"] and stats[c] > limits[n]:
            raise ValueError(f"an item exceeds the limit {limits[n]} of {sizes[n]}")
    bound = np.array(limits, np.int64)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", ignore_index=True)
        bins = pack_shard(pdf[cols].to_numpy(np.int64), bound)
        fill = np.bincount(bins, pdf["s0"].to_numpy(), minlength=1)
        pdf["bin"] = bins
        pdf["open"] = fill[bins] < (1 - slack) * cap if len(bins) else np.zeros(0, bool)
        return pdf

    schema = f"i {todo.schema['i'].dataType.simpleString()}, piece int, {', '.join(f'{c} bigint' for c in cols)}, u bigint, shard bigint, bin bigint, open boolean"
    done: list[DataFrame] = []
    n, step, held = int(stats["n"]), 0, None
    while True:
        shards = max(1, -(-n // shard_items))
        keyed = todo.withColumn("shard", F.pmod(F.xxhash64("u", F.lit(step)), F.lit(shards)))
        packed = cut(keyed.groupBy("shard").applyInPandas(shard, schema))
        box = F.struct("shard", "bin")
        got = packed.agg(F.countDistinct(box).alias("all"), F.countDistinct(F.when(F.col("open"), box)).alias("open"), F.count_if("open").alias("n")).first()
        last = shards == 1 or (held is not None and got["all"] > (1 - gain) * held)
        tag = F.lit(step << 56).bitwiseOR(F.shiftleft("shard", 24)).bitwiseOR(F.col("bin"))
        done.append((packed if last else packed.where("not open")).select("i", "piece", *cols, tag.alias("container_id")))
        if last:
            break
        todo = packed.where("open").drop("shard", "bin", "open")
        n, held, step = got["n"], got["open"], step + 1
    return union_all(done).select(F.col("i").alias(id_col), "piece", *[F.col(c).alias(s) for c, s in zip(cols, sizes, strict=True)], "container_id")
