"""Writers of matrices, graphs, clusters, containment, sketches and caches.

Text goes out from the executors, one line per entity. Single binary files are streamed by
the driver in order, a row at a time; Parquet is the native form for large results.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SketchConfig


def _cell(v: Column) -> Column:
    return F.coalesce(F.round(v, 6).cast("string"), F.lit("-"))


def matrix_text(values: DataFrame, names: DataFrame, path: str, phylip: bool = False) -> None:
    """Upper triangle ``values [i, j, value]`` with ``names [i, name]``, a line per entity in
    order of i: padded name, a dash for each j <= i, then the values."""
    n = names.count()
    line = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: _cell(x["value"]))
    rows = names.join(values.groupBy("i").agg(line.alias("l")), "i", "left").select("i", F.rpad("name", 9, " ").alias("short"), "name", F.coalesce("l", F.array().cast("array<string>")).alias("l"))
    label = F.when(F.length("name") < 9, F.col("short")).otherwise(F.col("name"))
    rank = F.row_number().over(Window.orderBy("i"))  # one line per entity, numbered in order
    fill = F.lit("") if phylip else F.repeat(F.lit("\t-"), F.col("r"))
    body = rows.withColumn("r", rank).select("r", F.concat(label, fill, F.when(F.size("l") > 0, F.concat(F.lit("\t"), F.array_join("l", "\t"))).otherwise(F.lit(""))).alias("value"))
    head = names.sparkSession.createDataFrame([(0, str(n))] if phylip else [(0, "#Similarity matrix, upper triangle")], "r int, value string")
    head.unionByName(body).orderBy("r").select("value").write.mode("overwrite").text(path)


def square_text(values: DataFrame, path: str) -> None:
    """Full rows ``[i, j, value]``, columns in order of j."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: _cell(x["value"]))
    values.groupBy("i").agg(line.alias("l")).orderBy("i").select(F.concat_ws("\t", F.col("i").cast("string"), F.array_join("l", "\t")).alias("value")).write.mode("overwrite").text(path)


def matrix_binary(values: DataFrame, path: str) -> None:
    """Values in order of (i, j) as 32-bit floats: condensed, square or rectangle."""
    with open(path, "wb") as f:
        for r in values.orderBy("i", "j").select("value").toLocalIterator():
            f.write(struct.pack("<f", r[0]))


def graph_text(edges: DataFrame, path: str, score: str = "score") -> None:
    """``name<TAB>nbr:score...`` of ``edges [i, j, score]``, best first."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("j")))), lambda x: F.concat(x["j"].cast("string"), F.lit(":"), F.round(-x["s"], 8).cast("string")))
    edges.groupBy("i").agg(cells.alias("c")).orderBy("i").select(F.concat_ws("\t", F.col("i").cast("string"), F.array_join("c", "\t")).alias("value")).write.mode("overwrite").text(path)


def graph_binary(edges: DataFrame, n: int, path: str, score: str = "score", id_type: str = "<u4") -> None:
    """u64 n and entries, u64 offsets, neighbour ids, float scores; ids are 0..n-1."""
    rows = edges.select("i", "j", score).orderBy("i", F.desc(score), "j")
    degree = {r["i"]: r["c"] for r in edges.groupBy("i").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()}
    ptr = np.concatenate([[0], np.cumsum([degree.get(i, 0) for i in range(n)])]).astype("<u8")
    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", n, int(ptr[-1])))
        f.write(ptr.tobytes())
        for r in rows.toLocalIterator():
            f.write(np.array(r["j"], id_type).tobytes())
        for r in rows.toLocalIterator():
            f.write(struct.pack("<f", r[score]))


def clusters_text(clusters: DataFrame, path: str) -> None:
    """``Cluster-c<TAB>rep:id<TAB>child:id...`` of ``[member, rep]``."""
    kids = F.array_sort(F.collect_list(F.when(F.col("member") != F.col("rep"), F.concat(F.lit("child:"), F.col("member").cast("string")))))
    rows = clusters.groupBy("rep").agg(kids.alias("k")).withColumn("c", F.row_number().over(Window.orderBy("rep")) - 1)
    rows.orderBy("c").select(F.concat_ws("\t", F.concat(F.lit("Cluster-"), F.col("c").cast("string")), F.concat(F.lit("rep:"), F.col("rep").cast("string")), F.when(F.size("k") > 0, F.array_join("k", "\t"))).alias("value")).write.mode("overwrite").text(path)


def clusters_binary(clusters: DataFrame, path: str) -> None:
    """u64 clusters and members, u64 offsets, u32 ids with the representative first."""
    rows = clusters.groupBy("rep").agg(F.array_sort(F.collect_list("member")).alias("m")).orderBy("rep")
    lists = [[r["rep"], *[m for m in r["m"] if m != r["rep"]]] for r in rows.toLocalIterator()]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("<u8")
    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", len(lists), int(ptr[-1])) + ptr.tobytes())
        for x in lists:
            f.write(np.array(x, "<u4").tobytes())


def representatives_fasta(clusters: DataFrame, seqs: DataFrame, path: str) -> None:
    """FASTA of the representatives; ``seqs [entity, name, seq]``."""
    reps = clusters.select(F.col("rep").alias("entity")).distinct()
    seqs.join(reps, "entity").select(F.concat(F.lit(">"), F.coalesce("name", F.col("entity").cast("string")), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def containment_text(rows: DataFrame, path: str) -> None:
    """``ref<TAB>query<TAB>cov%:depth`` lines."""
    cell = F.format_string("%.4f%%:%.4f", F.col("coverage") * 100, F.col("mean_depth"))
    rows.select(F.concat_ws("\t", F.col("ref").cast("string"), F.col("query").cast("string"), cell).alias("value")).write.mode("overwrite").text(path)


def stacked_binary(sketches: DataFrame, size: int, path: str, names: str) -> None:
    """Header, cardinalities, registers (empty ones 0) of ``[entity, name, card, sig]``, and
    the names file."""
    rows = sketches.orderBy("entity")
    n = sketches.count()
    with open(path, "wb") as f, open(names, "w") as g:
        f.write(struct.pack("<QQ", n, size))
        g.write("#Name\tCardinality\n")
        for r in rows.select("name", "card").toLocalIterator():
            f.write(struct.pack("<d", r["card"]))
            g.write(f"{r['name']}\t{r['card']:.12g}\n")
        for r in rows.select("sig").toLocalIterator():
            f.write(np.array([x or 0.0 for x in r["sig"]], "<f8").tobytes())


def minimizer_binary(seqs: DataFrame, k: int, w: int, kind: int, path: str) -> None:
    """Header, lengths and items of ``[entity, items]`` in order of entity."""
    rows = seqs.orderBy("entity")
    lens = [r[0] for r in rows.select(F.size("items")).toLocalIterator()]
    with open(path, "wb") as f:
        f.write(struct.pack("<QIII", len(lens), k, w, kind) + np.array(lens, "<f8").tobytes())
        for r in rows.select("items").toLocalIterator():
            f.write(np.array(r["items"], "<i8").tobytes())


def kmer_db_binary(sampled: DataFrame, size: int, k: int, w: int, path: str, alphabet: int = 0, canonical: bool = True, seed: int = 0) -> None:
    """Header and k-mer codes of ``[ref_id, kmers]`` (arrays of ``size``)."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IIIIQ", alphabet | int(canonical) << 8, size, k, w, seed))
        for r in sampled.orderBy("ref_id").select("kmers").toLocalIterator():
            f.write(np.array(r["kmers"], "<u8").tobytes())


def print_minimizers(rows: DataFrame, path: str, fasta: bool = False) -> None:
    """Decoded minimizer sequences ``[entity, items]``, one line each, as text or FASTA."""
    body = F.array_join(F.col("items").cast("array<string>"), "\n" if fasta else ",")
    line = F.concat(F.lit(">"), F.col("entity").cast("string"), F.lit("\n"), body) if fasta else F.concat_ws("\t", F.col("entity").cast("string"), body)
    rows.orderBy("entity").select(line.alias("value")).write.mode("overwrite").text(path)


def weighted_sketch_parquet(sampled: DataFrame, totals: DataFrame, path: str) -> None:
    """``[entity, reg, v, item, total_weight]``."""
    sampled.join(totals.select("entity", "total_weight"), "entity", "left").write.mode("overwrite").parquet(path)


class SketchCache:
    """Registers kept by configuration: entities found there are not sketched again.

    ``blocked`` names the block list the sketches were made with (such as a fingerprint of
    its files); sketches of another one are not used. An entity without any register is
    kept as a row of nulls, so that it counts as known."""

    def __init__(self, path: str, config: SketchConfig, blocked: str = ""):
        self.path = f"{path}/config={config.key()}-{hashlib.sha256(blocked.encode()).hexdigest()[:16] if blocked else 'none'}"

    def load(self, spark) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def missing(self, entities: DataFrame) -> DataFrame:
        held = self.load(entities.sparkSession)
        return entities if held is None else entities.join(held.select("entity").distinct(), "entity", "left_anti")

    def add(self, regs: DataFrame, entities: DataFrame) -> DataFrame:
        """Keep ``regs``, and return the registers of ``entities [entity]`` of this run only."""
        asked = entities.select("entity").distinct()
        regs.join(self.missing(asked), "entity", "right").write.mode("append").parquet(self.path)
        return regs.sparkSession.read.parquet(self.path).join(asked, "entity", "left_semi").where("reg is not null")
