"""Numeric vectors: preparation, exact pair cosines and the block matrix join.

The join deals distinct vectors into blocks. Each pair of blocks is one tile, computed in
one task from int8 codes: the integer products, scaled afterwards, give every cosine within
a known quantisation error, and only pairs that can still be among a row's best survive.
The rows' candidates are merged over the tiles by a heap of the k best lower bounds, and
what can still beat the k-th is recomputed from the original doubles. All bounds are on the
safe side, so the result is exact. Only int8 codes are sent to the tiles.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def dense(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, null and NaN as 0, short rows padded with 0; and
    which rows have a direction (not null, not all 0)."""
    n = len(col)
    out = np.zeros((n, dims))
    size = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = np.nan_to_num(np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float), posinf=0.0, neginf=0.0)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(n), size), at] = flat
    return out, np.abs(out).max(axis=1, initial=0.0) > 0


def packed(col: pa.Array, kind: str, dims: int) -> np.ndarray:
    """A column of equally long binaries as a matrix, without a copy per row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        return np.concatenate([packed(c, kind, dims) for c in col.chunks]) if col.num_chunks else np.zeros((0, dims), kind)
    raw = np.frombuffer(b"".join(col.to_pylist()), kind)
    return raw.reshape(len(col), dims)


def binaries(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, offsets.buffers()[1], pa.py_buffer(m.tobytes())])


def dimension(df: DataFrame, vec: str) -> int:
    return int(df.agg(F.max(F.size(vec))).first()[0] or 0)


def distinct_vectors(df: DataFrame, id_col: str, vec: str, k_col: str | None, default_k: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """``entities [id, rep, k]`` and ``vectors [rep, k, unit]``.

    Entities whose vectors are equal share one row of ``vectors``, whose ``rep`` is the
    smallest of their ids and whose ``k`` is the largest of theirs; ``unit`` is the unit
    vector in doubles.
    """
    k = F.lit(default_k) if k_col is None else F.coalesce(F.col(k_col).cast("int"), F.lit(default_k))
    src = df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), k.alias("k"), F.col(vec).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                m, ok = dense(b.column(2), dims)
                m, keep = m[ok], pa.array(ok)
                m += 0.0  # no negative zero in the fingerprint
                fp = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in m]
                top = np.abs(m).max(axis=1, keepdims=True)
                unit = m / top
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(fp, pa.binary()), binaries(unit)], ["id", "k", "fp", "unit"])

    rows = src.mapInArrow(run, "id bigint, k int, fp binary, unit binary")
    ents = rows.groupBy("id").agg(F.max("k").alias("k"), F.min("fp").alias("fp"))
    reps = ents.groupBy("fp").agg(F.min("id").alias("rep"), F.max("k").alias("k"))
    entities = ents.join(reps.select("fp", "rep"), "fp").select("id", "rep", "k")
    vectors = rows.select(F.col("id").alias("rep"), "fp", "unit").join(reps, ["rep", "fp"]).dropDuplicates(["rep"]).select("rep", "k", "unit")
    return cut(entities), cut(vectors)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 codes, their scale, and the norm of what the codes lose."""
    scale = np.abs(unit).max(axis=1, keepdims=True, initial=1e-300) / 127.0
    code = np.rint(unit / scale)
    return code.astype(np.int8), scale[:, 0], np.sqrt(((unit - code * scale) ** 2).sum(axis=1)) + 1e-7


def exact_cosines(pairs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """``[a, b, sim]`` of the pairs, from the doubles, rounded to 9 decimals."""
    va = vectors.select(F.col("rep").alias("a"), F.col("unit").alias("ua"))
    vb = vectors.select(F.col("rep").alias("b"), F.col("unit").alias("ub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dot = np.einsum("ij,ij->i", packed(b.column(2), "<f8", dims), packed(b.column(3), "<f8", dims)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(dot, 9))], ["a", "b", "sim"])

    return pairs.join(va, "a").join(vb, "b").select("a", "b", "ua", "ub").mapInArrow(run, "a bigint, b bigint, sim double")


def _best(src: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions that can be among their source's k best: whose upper bound reaches the
    k-th largest lower bound. ``k`` by position."""
    if not len(src):
        return np.zeros(0, np.int64)
    order = np.lexsort((-low, src))
    s = src[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    length = np.diff(np.concatenate([start, [len(s)]]))
    kth = low[order][start + np.minimum(np.maximum(k[order][start], 1), length) - 1]
    return order[high[order] >= np.repeat(kth, length)]


def _tile(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], floor: float, same: bool) -> tuple[np.ndarray, ...]:
    """Survivors (row, column, lower and upper bound of the cosine) of one tile; a side is
    (codes, scale, loss, k); ``same``: both sides are one block. The product of int8 codes is
    computed in float32, which holds its integers exactly up to 1,000 dimensions."""
    (lq, ls, le, lk), (rq, rs, re, rk) = left, right
    kind = np.float32 if lq.shape[1] <= 1000 else np.float64
    lf, rf = lq.astype(kind), rq.astype(kind)
    rmax, kmax = float(re.max()), int(max(lk.max(), rk.max(), 1))
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(lf), 512):
        at = slice(lo, lo + 512)
        g = (lf[at] @ rf.T) * ls[at, None].astype(kind) * rs[None, :].astype(kind)
        err = le[at] + rmax * (1 + le[at]) + 1e-5
        limit = floor - err
        if same:
            g[np.arange(len(g)), lo + np.arange(len(g))] = -2
        hits = g >= limit[:, None]
        if np.count_nonzero(hits) > 64 * kmax * len(g) and g.shape[1] > kmax:
            # a dense region: a pair must be among the best of its row or of its column
            row = np.maximum(np.partition(g, -kmax, axis=1)[:, -kmax] - 2 * err, limit)
            col = np.partition(g, -min(kmax, len(g)), axis=0)[-min(kmax, len(g))] - 2 * float(err.max())
            hits &= (g >= row[:, None]) | (g >= np.maximum(col, limit.min())[None, :])
        i, j = np.nonzero(hits)
        s, e = g[i, j].astype(float), le[lo + i] + re[j] * (1 + le[lo + i]) + 1e-5
        ok = s + e >= floor
        found.append((i[ok] + lo, j[ok], (s - e)[ok], (s + e)[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, low, high, k) sorted by a: the pairs whose upper bound reaches the
    smallest of a's heap of k largest lower bounds. A run holds a few candidates per tile."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> pa.RecordBatch:
        a, b, low, high, k = (t.column(i).to_numpy() for i in range(5))
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        ends = np.append(start[1:], len(a))
        kth = np.full(len(a), -2.0)
        for lo, hi in zip(start[ends - start > k[start]], ends[ends - start > k[start]], strict=True):
            kth[lo:hi] = heapq.nlargest(max(int(k[lo]), 1), low[lo:hi].tolist())[-1]
        ok = high >= kth
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], ["a", "b"])

    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        t = pa.Table.from_batches(held)
        keys = t.column(0).to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if whole:
            yield flush(t.slice(0, whole))
            held = t.slice(whole).combine_chunks().to_batches()
    if held:
        yield flush(pa.Table.from_batches(held))


def knn_join(vectors: DataFrame, dims: int, floor: float, block: int | None = None) -> DataFrame:
    """``[a, b, sim]``, a <> b, both directions: for each distinct vector at least its k
    most similar other distinct vectors with a cosine of ``floor`` or more."""
    spark = vectors.sparkSession
    n = vectors.count()
    if block is None:
        block = int(min(16384, max(512, math.ceil(n / (2 * spark.sparkContext.defaultParallelism)))))
    blocks = max(1, math.ceil(n / block))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, scale, loss = quantised(packed(b.column(2), "<f8", dims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binaries(q), pa.array(scale), pa.array(loss)], ["rep", "k", "q", "scale", "loss"])

    coded = vectors.select("rep", "k", "unit").mapInArrow(codes, "rep bigint, k int, q binary, scale double, loss double")
    blk = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    cols = ["rep", "k", "q", "scale", "loss", "blk"]
    sent = coded.withColumn("blk", blk).select(*cols, other).select(*cols, F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"))
    tiles = blocks * (blocks + 1) // 2

    def tile(t: pa.Table) -> pa.Table:
        ti, tj = t.column("ti")[0].as_py(), t.column("tj")[0].as_py()
        side = t.column("blk").to_numpy()
        rep, k, scale, loss = (t.column(c).to_numpy() for c in ("rep", "k", "scale", "loss"))
        m = packed(t.column("q"), "i1", dims)
        x, y = np.flatnonzero(side == ti), np.flatnonzero(side == tj)
        if not len(x) or not len(y):
            none = pa.array([], pa.int64())
            return pa.table({"a": none, "b": none, "low": none.cast(pa.float64()), "high": none.cast(pa.float64()), "k": none.cast(pa.int32())})
        i, j, low, high = _tile((m[x], scale[x], loss[x], k[x]), (m[y], scale[y], loss[y], k[y]), floor, ti == tj)
        i, j = x[i], y[j]
        fwd = _best(i, low, high, k[i])
        out = [(i[fwd], j[fwd], low[fwd], high[fwd])]
        if ti != tj:
            rev = _best(j, low, high, k[j])
            out.append((j[rev], i[rev], low[rev], high[rev]))
        i, j, low, high = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": rep[i], "b": rep[j], "low": low, "high": high, "k": k[i].astype(np.int32)})

    # a tile is a bounded group: two blocks
    near = sent.repartition(min(tiles, 20_000), "ti", "tj").groupBy("ti", "tj").applyInArrow(tile, "a bigint, b bigint, low double, high double, k int")
    best = near.repartition("a").sortWithinPartitions("a").mapInArrow(_merged, "a bigint, b bigint").distinct()
    sims = cut(exact_cosines(best, vectors, dims).where(F.col("sim") >= floor))
    return sims.select(F.explode(F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))).alias("e")).select("e.*")


def nearest(df: DataFrame, id_col: str, vec: str, k_col: str | None = None, default_k: int = 5, floor: float = 0.0, block: int | None = None) -> DataFrame:
    """``[entity, neighbour, sim, rk]``: for every entity its k most similar entities.

    k is ``k_col`` of the entity, ``default_k`` where that is null; below 1 means none.
    Similarity is the cosine, rounded to 9 decimals, and must reach ``floor``; ties go to
    the smaller id. Null and NaN registers count as 0; an entity whose vector is null,
    empty or all 0 has no neighbours and is none. Shorter vectors are padded with 0. An
    entity given twice counts once (of different vectors one is kept, the largest k). Other
    columns are not read; an empty table gives no rows.

    Copies of a vector are compared once; of a group of copies of any size, only the k + 1
    smallest ids can be anyone's neighbours, so no group is spread out.
    """
    spark = df.sparkSession
    dims = dimension(df, vec)
    if not dims:
        return spark.createDataFrame([], "entity bigint, neighbour bigint, sim double, rk int")
    entities, vectors = distinct_vectors(df, id_col, vec, k_col, default_k, dims)
    sims = knn_join(vectors, dims, floor, block)
    kmax = vectors.select("rep", F.col("k").alias("km"))
    most = int(entities.agg(F.max("k")).first()[0] or 0)
    if most < 1:
        return spark.createDataFrame([], "entity bigint, neighbour bigint, sim double, rk int")
    first = entities.withColumn("m", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("m") <= most + 1).select("rep", F.col("id").alias("neighbour"))
    links = sims.unionByName(kmax.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim")))
    pool = links.join(first, links["b"] == first["rep"]).select(F.col("a").alias("rep"), "neighbour", "sim")
    pool = pool.withColumn("p", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "neighbour"))).where(F.col("p") <= most + 1)
    mine = entities.join(pool, "rep").where("id <> neighbour")
    rk = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return mine.withColumn("rk", rk).where("rk <= k").select(F.col("id").alias("entity"), "neighbour", "sim", "rk")
