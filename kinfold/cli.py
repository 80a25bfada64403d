"""Command line: ``python -m kinfold.cli sketch|cmp|contain|wsketch|printmin``.

Sketches are Parquet tables with their configuration in the path; ``cmp`` reads them.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Kind, SketchConfig, Space
from .functions import measures as M
from .operators import counting as C
from .operators import features as K
from .operators import filters as FL
from .operators import neighbours as N
from .operators import pairs as P
from .operators import sketches as S
from .sinks.writers import SketchCache, matrix_text
from .sources import binary, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-k", type=int, default=31)
    shared.add_argument("-S", "--size", type=int, default=1024)
    shared.add_argument("-w", "--window", type=int, default=0)
    shared.add_argument("-m", "--min-count", type=int, default=1)
    shared.add_argument("--seed")
    shared.add_argument("--spacing")
    shared.add_argument("--no-canon", action="store_true")
    shared.add_argument("--downsample", type=float, default=1.0)
    shared.add_argument("--filterset", help="sequence file whose k-mers are left out")
    shared.add_argument("--parse-by-seq", action="store_true", help="an entity per record instead of per file")
    shared.add_argument("--space", choices=[s.value for s in Space], default="set")
    shared.add_argument("--measure", choices=[m.value for m in M.Measure], default="similarity")
    shared.add_argument("--topk", type=int)
    shared.add_argument("--similarity-threshold", type=float)
    shared.add_argument("--greedy", type=float, help="cluster at this similarity")
    shared.add_argument("--cache")
    shared.add_argument("--phylip", action="store_true")
    shared.add_argument("-o", "--out", required=True)
    for name in ("sketch", "cmp"):
        q = sub.add_parser(name, parents=[shared])
        q.add_argument("inputs", nargs="+", help="sequence files, or for cmp the sketch tables")
    q = sub.add_parser("contain")
    q.add_argument("-k", type=int, default=31)
    q.add_argument("-o", "--out", required=True)
    q.add_argument("database", help="Parquet table [ref, kmer]")
    q.add_argument("inputs", nargs="+")
    q = sub.add_parser("wsketch")
    q.add_argument("-S", "--size", type=int, default=1024)
    q.add_argument("-B", "--bagminhash", action="store_true")
    q.add_argument("-o", "--out", required=True)
    q.add_argument("ids")
    q.add_argument("weights", nargs="?")
    q.add_argument("indptr", nargs="?")
    q = sub.add_parser("printmin")
    q.add_argument("-o", "--out", required=True)
    q.add_argument("file")
    return p


def config(a: argparse.Namespace) -> SketchConfig:
    return SketchConfig(a.k, a.size, a.window, Space(a.space), Kind.ONE_PERMUTATION, "dna", not a.no_canon, a.seed, a.min_count, a.downsample, a.spacing).checked()


def _print(spark: SparkSession, paths: str) -> str:
    """A fingerprint of sequence files, whatever the order of their records."""
    r = files.read_fastx(spark, paths).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("seq")), F.bit_xor(F.xxhash64("seq", F.lit(1)))).first()
    return ",".join(str(x) for x in r)


def sketch(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Registers ``[entity, reg, v]`` and totals ``[entity, card]`` of sequence files."""
    cfg = config(a)
    rec = files.read_fastx(spark, ",".join(a.inputs))
    entity = F.concat_ws(":", "path", F.col("ordinal").cast("string")) if a.parse_by_seq else F.col("path")
    seqs = rec.select(entity.alias("entity"), K.clean(F.col("seq")).alias("seq"))
    cache = SketchCache(a.cache, cfg, _print(spark, a.filterset) if a.filterset else "") if a.cache else None
    todo = cache.missing(seqs) if cache else seqs
    offsets = K.spacing(cfg.spacing) if cfg.spacing else None
    km = K.kmers(todo, "entity", "seq", cfg.k, canon=cfg.canonical, offsets=offsets)
    if a.filterset:
        blocked = K.kmers(files.read_fastx(spark, a.filterset).select(F.lit(0).alias("entity"), K.clean(F.col("seq")).alias("seq")), "entity", "seq", cfg.k, canon=cfg.canonical, offsets=offsets)
        km = FL.block(km, blocked, "kmer")
    km = FL.downsample(km, "kmer", cfg.fraction, cfg.seed)
    if cfg.window > cfg.k:
        km = K.minimizers(km, cfg.window - cfg.k + 1, seed=cfg.seed).select("entity", "pos", F.col("h").cast("string").alias("kmer"))
    if cfg.space is Space.EDIT:
        regs = S.orderminhash(km, "kmer", cfg.size)
    else:
        counts = C.counts(km, "kmer")
        counts = FL.min_count(counts, cfg.min_count) if cfg.min_count > 1 else counts
        if cfg.space is Space.MULTISET:
            regs = S.bagminhash(counts, "kmer", "cnt", cfg.size)
        elif cfg.space is Space.PROBABILITY:
            regs = S.probminhash(counts, "kmer", "cnt", cfg.size).select("entity", "reg", S.h60(F.col("item")).alias("v"))
        else:
            regs = S.oph(counts, "kmer", cfg.size, cfg.seed)
    regs = cache.add(regs, seqs) if cache else regs
    if cfg.space in (Space.PROBABILITY, Space.EDIT):
        # registers of these spaces are no bucket minima: weigh by the number of k-mers
        every = K.kmers(seqs, "entity", "seq", cfg.k, canon=cfg.canonical, offsets=offsets)
        return regs, every.groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("card"))
    return regs, S.oph_cardinality(regs, cfg.size)


def compare(regs: DataFrame, cards: DataFrame, a: argparse.Namespace) -> DataFrame:
    """``[i, j, score]`` in the measure asked for, of pairs that share a register."""
    cfg = config(a)
    kind = M.Measure(a.measure)
    cfg.allows(kind)
    dense = S.densify(regs, cfg.size) if cfg.space is Space.SET else regs
    q = P.with_sizes(P.register_pairs(dense), cards, "card").withColumn("jac", M.similarity(F.col("eq"), cfg.size))
    edges = q.select("i", "j", M.measure(kind, F.col("jac"), F.col("a"), F.col("b"), cfg.k).alias("score"))
    if a.similarity_threshold is not None:
        edges = FL.threshold(edges, "score", a.similarity_threshold, kind.is_distance)
    if a.topk:
        edges = N.topk(N.both_ways(FL.nonzero(edges, "score") if not kind.is_distance else edges, "score"), "score", a.topk, kind.is_distance)
    return edges


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    if a.command in ("sketch", "cmp"):
        if a.command == "sketch":
            regs, cards = sketch(spark, a)
            regs.write.mode("overwrite").parquet(f"{a.out}/registers")
            regs, cards = spark.read.parquet(f"{a.out}/registers"), cards
        else:
            regs = spark.read.parquet(*[f"{p}/registers" for p in a.inputs])
            cards = S.oph_cardinality(regs, a.size)
        edges = compare(regs, cards, a)
        edges.write.mode("overwrite").parquet(f"{a.out}/pairs")
        if a.greedy is not None:
            from pyspark.sql import Window

            order = cards.select("entity", F.row_number().over(Window.orderBy(F.desc("card"), "entity")).alias("pos"))
            N.greedy_clusters(FL.threshold(edges.select("i", "j", "score"), "score", a.greedy), order).write.mode("overwrite").parquet(f"{a.out}/clusters")
        if a.phylip:
            names = cards.select(F.col("entity").alias("i"), F.col("entity").cast("string").alias("name"))
            matrix_text(P.all_pairs(cards.select("entity"), edges, "score"), names, f"{a.out}/matrix", phylip=True)
    elif a.command == "contain":
        seqs = files.read_fastx(spark, ",".join(a.inputs)).select(F.col("path").alias("entity"), K.clean(F.col("seq")).alias("seq"))
        N.containment(K.kmers(seqs, "entity", "seq", a.k), spark.read.parquet(a.database), "kmer").write.mode("overwrite").parquet(a.out)
    elif a.command == "wsketch":
        rows = binary.read_csr(spark, a.ids, a.weights, a.indptr) if a.indptr else binary.read_weighted_vector(spark, a.ids, a.weights).withColumn("row_id", F.lit(0))
        src = rows.withColumnRenamed("row_id", "entity")
        make = S.bagminhash if a.bagminhash else S.probminhash
        make(src, "item", "weight", a.size).write.mode("overwrite").parquet(a.out)
    else:
        _, rows = binary.read_minimizer_sequences(spark, a.file)
        rows.orderBy("seq_id", "pos").write.mode("overwrite").csv(a.out, sep="\t")


if __name__ == "__main__":
    main()
