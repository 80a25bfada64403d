"""Readers of binary vectors, sketches and results.

Large vectors are read in ranges: a range of element numbers is dealt to the executors, and
each reads its slice from the shared file. Compressed vectors are read in one piece.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_any

_CHUNK = 1 << 22
_SQL = {"i": "bigint", "u": "bigint", "f": "double"}


def _count(path: str, dtype: str, offset: int) -> int:
    import os

    return (os.path.getsize(path) - offset) // np.dtype(dtype).itemsize


def read_vector(spark: SparkSession, path: str, dtype: str, offset: int = 0, count: int | None = None, name: str = "x") -> DataFrame:
    """``[pos, <name>]``: elements of a raw vector with their positions."""
    kind = np.dtype(dtype)
    out = "int64" if kind.kind in "iu" else "float64"
    if path.endswith((".gz", ".bz2", ".xz", ".zst")):
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    with open_any(path) as f:
                        v = np.frombuffer(f.read()[offset:], kind)[:count].astype(out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["pos", name])

        return spark.range(1).mapInArrow(whole, f"pos bigint, {name} {_SQL[kind.kind]}")
    n = _count(path, dtype, offset) if count is None else count

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                v = np.fromfile(path, kind, min(_CHUNK, n - start), offset=offset + start * kind.itemsize).astype(out)
                yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(len(v))), pa.array(v)], ["pos", name])

    return spark.range(0, n, _CHUNK).mapInArrow(part, f"pos bigint, {name} {_SQL[kind.kind]}")


def read_weighted_vector(spark: SparkSession, ids: str, weights: str | None, id_type: str = "<u8", weight_type: str = "<f8") -> DataFrame:
    """``[item, weight]``; without a weight file every weight is 1."""
    left = read_vector(spark, ids, id_type, name="item")
    if weights in (None, "-"):
        return left.select("item", F.lit(1.0).alias("weight"))
    return left.join(read_vector(spark, weights, weight_type, name="weight"), "pos").select("item", F.col("weight").cast("double").alias("weight"))


def read_csr(spark: SparkSession, ids: str, weights: str | None, indptr: str, id_type: str = "<u8", weight_type: str = "<f8", ptr_type: str = "<u8") -> DataFrame:
    """``[row_id, item, weight]`` of a sparse matrix in three files."""
    ptr = np.fromfile(indptr, np.dtype(ptr_type)).astype(np.int64)
    left = read_vector(spark, ids, id_type, name="item")
    if weights in (None, "-"):
        left = left.withColumn("weight", F.lit(1.0))
    else:
        left = left.join(read_vector(spark, weights, weight_type, name="weight"), "pos")
    shared = spark.sparkContext.broadcast(ptr)  # one offset per row of the matrix, held by every reader of this layout

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.searchsorted(shared.value, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(r), b.column(1), b.column(2)], ["row_id", "item", "weight"])

    return left.select("pos", "item", F.col("weight").cast("double").alias("weight")).mapInArrow(rows, "row_id bigint, item bigint, weight double")


def read_stacked(spark: SparkSession, path: str, names: str | None = None, dtype: str = "<f8") -> DataFrame:
    """``[entity_id, name, card, sig]`` of a stacked sketch file and its names file."""
    with open(path, "rb") as f:
        n, size = struct.unpack("<QQ", f.read(16))
    card = read_vector(spark, path, "<f8", 16, n, "card").select(F.col("pos").alias("entity_id"), "card")
    regs = read_vector(spark, path, dtype, 16 + 8 * n, n * size, "v").select((F.col("pos") / size).cast("bigint").alias("entity_id"), (F.col("pos") % size).alias("r"), "v")
    sig = regs.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"].cast("double")).alias("sig"))
    out = card.join(sig, "entity_id", "left") if size else card.withColumn("sig", F.array().cast("array<double>"))
    if names is None:
        return out.select("entity_id", F.lit(None).cast("string").alias("name"), "card", "sig")
    with open_any(names) as f:
        labels = [x.decode().split("\t")[0] for x in f.read().splitlines() if not x.startswith(b"#")]
    lab = spark.createDataFrame(list(enumerate(labels)), "entity_id bigint, name string")
    return out.join(lab, "entity_id", "left").select("entity_id", "name", "card", "sig")


def read_sketches(spark: SparkSession, paths: str, dtype: str = "<f8") -> DataFrame:
    """``[path, card, sig, kmers, counts]`` of per-entity sketch files with their sidecars."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                local = p.removeprefix("file:")
                side = lambda s, t: np.fromfile(local + s, t).tolist() if os.path.exists(local + s) else None  # noqa: B023, E731
                vals = (p, struct.unpack("<d", data[:8])[0], np.frombuffer(data[8:], dtype).astype(float).tolist(), side(".kmerhashes.u64", "<i8"), side(".kmercounts.f64", "<f8"))
                for c, v in zip(out, vals, strict=True):
                    c.append(v)
            types = [pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["path", "card", "sig", "kmers", "counts"])

    files = spark.read.format("binaryFile").load(paths.split(",")).select("path", "content")
    return files.mapInArrow(run, "path string, card double, sig array<double>, kmers array<bigint>, counts array<double>")


def read_kmer_db(spark: SparkSession, path: str, names: str | None = None) -> tuple[dict, DataFrame]:
    """The header of a k-mer database and ``[ref_id, ref, reg, kmer]``."""
    with open(path, "rb") as f:
        flags, size, k, w, seed = struct.unpack("<IIIIQ", f.read(24))
    head = {"alphabet": flags & 0xFF, "canonical": bool(flags >> 8 & 1), "size": size, "k": k, "w": w, "seed": seed}
    rows = read_vector(spark, path, "<u8", 24, None, "kmer")
    out = rows.select((F.col("pos") / size).cast("bigint").alias("ref_id"), (F.col("pos") % size).cast("int").alias("reg"), "kmer")
    if names is None:
        return head, out.select("ref_id", F.col("ref_id").cast("string").alias("ref"), "reg", "kmer")
    with open_any(names) as f:
        labels = [x.decode().split("\t")[0] for x in f.read().splitlines() if not x.startswith(b"#")]
    lab = spark.createDataFrame(list(enumerate(labels)), "ref_id bigint, ref string")
    return head, out.join(lab, "ref_id", "left").select("ref_id", "ref", "reg", "kmer")


def read_minimizer_sequences(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header and ``[seq_id, pos, minimizer]`` of a minimizer sequence file."""
    with open(path, "rb") as f:
        n, k, w, kind = struct.unpack("<QIII", f.read(20))
        lens = np.frombuffer(f.read(8 * n), "<f8").astype(np.int64)
    ends = np.cumsum(lens)
    table = spark.createDataFrame([(i, int(e - m), int(e)) for i, (e, m) in enumerate(zip(ends, lens, strict=True))], "seq_id bigint, lo bigint, hi bigint")
    rows = read_vector(spark, path, "<u8", 20 + 8 * n, int(ends[-1]) if n else 0, "minimizer")
    out = rows.join(table, (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select("seq_id", (F.col("pos") - F.col("lo")).cast("int").alias("pos"), "minimizer")
    return {"k": k, "w": w, "dtype": kind}, out


def read_knn(spark: SparkSession, path: str, id_type: str = "<u4") -> DataFrame:
    """``[row_id, rank, nbr, score]`` of a binary neighbour graph."""
    with open(path, "rb") as f:
        n, nnz = struct.unpack("<QQ", f.read(16))
        ptr = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
    at = 16 + 8 * (n + 1)
    nbr = read_vector(spark, path, id_type, at, nnz, "nbr")
    score = read_vector(spark, path, "<f4", at + nnz * np.dtype(id_type).itemsize, nnz, "score")
    shared = spark.sparkContext.broadcast(ptr)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(0).to_numpy()
            r = np.searchsorted(shared.value, p, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array((p - shared.value[r]).astype(np.int32)), b.column(1), b.column(2)], ["row_id", "rank", "nbr", "score"])

    return nbr.join(score, "pos").select("pos", "nbr", "score").mapInArrow(rows, "row_id bigint, rank int, nbr bigint, score double")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``[cluster_id, rep_id, member_id]``: u64 clusters and members, offsets, then ids, the
    representative first."""
    with open(path, "rb") as f:
        n, nnz = struct.unpack("<QQ", f.read(16))
        ptr = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
        ids = np.frombuffer(f.read(4 * nnz), "<u4").astype(np.int64)
    rows = [(c, int(ids[ptr[c]]), int(m)) for c in range(n) for m in ids[ptr[c] : ptr[c + 1]]]
    return spark.createDataFrame(rows, "cluster_id bigint, rep_id bigint, member_id bigint")


def read_condensed(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``[i, j, value]`` of a condensed float matrix of n entities."""
    v = read_vector(spark, path, "<f4", 0, n * (n - 1) // 2, "value")
    b = 2 * n - 1
    i = F.floor((b - F.sqrt(F.lit(float(b * b)) - 8.0 * F.col("pos"))) / 2)
    i = i - (i * (b - i) / 2 > F.col("pos")).cast("int")
    row = v.withColumn("i", i.cast("bigint"))
    start = F.col("i") * (F.lit(b) - F.col("i")) / 2
    return row.select("i", (F.col("pos") - start + F.col("i") + 1).cast("bigint").alias("j"), "value")


def read_rectangle(spark: SparkSession, path: str, columns: int) -> DataFrame:
    v = read_vector(spark, path, "<f4", 0, None, "value")
    return v.select((F.col("pos") / columns).cast("bigint").alias("i"), (F.col("pos") % columns).alias("j"), "value")


def read_containment(spark: SparkSession, path: str) -> DataFrame:
    """``[ref, query, coverage, mean_depth]`` by number, of a binary containment result."""
    with open(path, "rb") as f:
        refs, queries = struct.unpack("<QQ", f.read(16))
    n = refs * queries
    cov, dep = read_vector(spark, path, "<f4", 16, n, "coverage"), read_vector(spark, path, "<f4", 16 + 4 * n, n, "mean_depth")
    return cov.join(dep, "pos").select((F.col("pos") % refs).alias("ref"), (F.col("pos") / refs).cast("bigint").alias("query"), "coverage", "mean_depth")
