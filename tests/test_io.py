import bz2
import gzip
import lzma
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from kinfold import sqlapi
from kinfold.cli import main
from kinfold.config import SketchConfig
from kinfold.operators import sketches as S
from kinfold.sinks import writers as W
from kinfold.sources import binary as B
from kinfold.sources import files as FS
from kinfold.streaming import sketching as ST

FASTA = ">s1 desc\nACGTACGTNN\nACGT\n>s2\nTTTTACGT\n"
FASTQ = "@a\nACGT\n+\nFF:F\n@b\nAC\nGT\n+\nFFF\n@\n"


def test_fastx_in_all_codecs(spark, tmp_path):
    for name, op in (("x.fa", open), ("x.fa.gz", gzip.open), ("x.fa.bz2", bz2.open), ("x.fa.xz", lzma.open)):
        with op(tmp_path / name, "wt") as f:
            f.write(FASTA)
        got = [tuple(r) for r in FS.read_fastx(spark, str(tmp_path / name)).select("name", "seq", "qual").collect()]
        assert got == [("s1 desc", "ACGTACGTNNACGT", None), ("s2", "TTTTACGT", None)]
    (tmp_path / "q.fq").write_text(FASTQ)
    got = [tuple(r) for r in FS.read_fastx(spark, str(tmp_path / "q.fq")).select("name", "seq", "qual").collect()]
    assert got == [("a", "ACGT", "FF:F"), ("b", "ACGT", "FFF@")]
    (tmp_path / "e.fa").write_text("")
    assert FS.read_fastx(spark, str(tmp_path / "e.fa")).count() == 0
    pairs = FS.read_pairs(spark, str(tmp_path / "x.fa"), str(tmp_path / "q.fq")).collect()
    assert len(pairs) == 2 and {r["r2"]["name"] for r in pairs} == {"a", "b"}


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t10\t13\tx\n#c\n\nchr2\t0\t2\ty\n")
    assert sorted(tuple(r)[1:] for r in FS.read_bed(spark, str(tmp_path / "a.bed"), True).collect()) == [("1", 10, 13), ("2", 0, 2)]
    (tmp_path / "s.txt").write_text("chrom s1 s2\nchr1:10:20:clu_1 3/5 0/4\n")
    assert sorted(map(tuple, FS.read_splice(spark, str(tmp_path / "s.txt")).collect())) == [("s1", "chr1:10:20:clu_1", 3, 5), ("s2", "chr1:10:20:clu_1", 0, 4)]
    (tmp_path / "l.txt").write_text("a b\nc\n")
    assert FS.read_paths(spark, str(tmp_path / "l.txt"), str(tmp_path / "l.txt")).where("is_query").count() == 3
    assert [tuple(r) for r in FS.read_pair_list(spark, str(tmp_path / "l.txt")).where("rhs is not null").collect()] == [("a", "b")]
    (tmp_path / "g.bedgraph").write_text("chr1 0 5 1.5\n")
    assert FS.read_bedgraph(spark, str(tmp_path / "g.bedgraph")).first()["value"] == 1.5


def bigwig(path):
    chrom = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    block = zlib.compress(struct.pack("<IIIIIBBH", 0, 10, 20, 0, 0, 1, 0, 2) + struct.pack("<IIf", 10, 13, 1.5) + struct.pack("<IIf", 15, 20, 2.0))
    chrom_at, data_at = 64, 64 + len(chrom)
    index_at = data_at + len(block)
    tree = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, 10, 0, 20, 0, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 10, 0, 20, data_at, len(block))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, chrom_at, data_at, index_at, 0, 0, 0, 0, 4096, 0)
    path.write_bytes(head + chrom + block + tree)


def test_bigwig(spark, tmp_path):
    bigwig(tmp_path / "x.bw")
    assert sorted(tuple(r)[1:] for r in FS.read_bigwig(spark, str(tmp_path / "x.bw")).collect()) == [("chr1", 10, 13, 1.5), ("chr1", 15, 20, 2.0)]


def test_binary_round_trips(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    np.array([5, 6, 7], "<u8").tofile(p("ids"))
    np.array([1.0, 2.0, 0.5], "<f8").tofile(p("w"))
    np.array([0, 2, 2, 3], "<u8").tofile(p("ptr"))
    assert sorted(map(tuple, B.read_csr(spark, p("ids"), p("w"), p("ptr")).collect())) == [(0, 5, 1.0), (0, 6, 2.0), (2, 7, 0.5)]
    assert B.read_weighted_vector(spark, p("ids"), "-").agg(F.sum("weight")).first()[0] == 3
    sk = spark.createDataFrame([(0, "a", 3.5, [1.0, 2.0]), (1, "b", 4.5, [3.0, None])], "entity bigint, name string, card double, sig array<double>")
    W.stacked_binary(sk, 2, p("st"), p("st.names"))
    assert sorted(map(tuple, B.read_stacked(spark, p("st"), p("st.names")).collect())) == [(0, "a", 3.5, [1.0, 2.0]), (1, "b", 4.5, [3.0, 0.0])]
    e = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.75), (2, 0, 0.75)], "i bigint, j bigint, score double")
    W.graph_binary(e, 3, p("knn"))
    assert sorted(map(tuple, B.read_knn(spark, p("knn")).collect())) == [(0, 0, 2, 0.75), (0, 1, 1, 0.5), (2, 0, 0, 0.75)]
    c = spark.createDataFrame([(0, 0), (3, 0), (1, 1)], "member bigint, rep bigint")
    W.clusters_binary(c, p("cl"))
    assert sorted(map(tuple, B.read_clusters(spark, p("cl")).collect())) == [(0, 0, 0), (0, 0, 3), (1, 1, 1)]
    W.clusters_text(c, p("cltext"))
    assert sorted(r[0] for r in spark.read.text(p("cltext")).collect()) == ["Cluster-0\trep:0\tchild:3", "Cluster-1\trep:1"]
    W.graph_text(e, p("gtext"))
    assert spark.read.text(p("gtext")).orderBy("value").first()[0] == "0\t2:0.75\t1:0.5"
    v = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(4) for j in range(i + 1, 4)], "i bigint, j bigint, value double")
    W.matrix_binary(v, p("mat"))
    assert sorted(map(tuple, B.read_condensed(spark, p("mat"), 4).collect())) == sorted(map(tuple, v.collect()))
    W.matrix_text(v, spark.createDataFrame([(i, f"n{i}") for i in range(4)], "i bigint, name string"), p("tri"))
    lines = [r[0] for r in spark.read.text(p("tri")).collect()]
    assert any(x.startswith("n2       \t-\t-\t-\t23") for x in lines)
    m = spark.createDataFrame([(0, [7, 8]), (1, [9])], "entity bigint, items array<bigint>")
    W.minimizer_binary(m, 5, 9, 0, p("mm"))
    head, rows = B.read_minimizer_sequences(spark, p("mm"))
    assert head["k"] == 5 and sorted(map(tuple, rows.collect())) == [(0, 0, 7), (0, 1, 8), (1, 0, 9)]
    W.kmer_db_binary(spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "ref_id bigint, kmers array<bigint>"), 2, 5, 9, p("db"))
    head, rows = B.read_kmer_db(spark, p("db"))
    assert head["canonical"] and sorted((r["ref_id"], r["reg"], r["kmer"]) for r in rows.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]


def test_cache_only_sketches_what_is_missing(spark, tmp_path):
    cache = W.SketchCache(str(tmp_path / "c"), SketchConfig(5))
    ents = spark.createDataFrame([(1, 5), (2, 6)], "entity bigint, item bigint")
    assert cache.missing(ents).count() == 2
    cache.add(S.oph(ents.where("entity = 1"), "item", 4), ents.where("entity = 1"))
    assert [r["entity"] for r in cache.missing(ents).collect()] == [2]
    again = cache.add(S.oph(ents.where("entity = 2"), "item", 4), ents.where("entity = 2"))
    assert {r["entity"] for r in again.collect()} == {2}
    other = W.SketchCache(str(tmp_path / "c"), SketchConfig(5), "a block list")
    assert other.missing(ents).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(60)], "entity bigint, item bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ST.stream_oph(stream, "entity", "item", 8).writeStream.outputMode("complete").format("memory").queryName("oph").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("oph").collect())) == sorted(map(tuple, S.oph(rows, "item", 8).collect()))
    w = ST.windowed_oph(stream, "ts", "item", 8, "1 day", "1 hour").writeStream.outputMode("append").format("memory").queryName("win").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("win").count() > 0
    step = ST.online_candidates(str(tmp_path / "ix"), str(tmp_path / "cand"), 8)
    regs = S.densify(S.oph(rows, "item", 8), 8)
    step(regs, 0)
    step(regs.withColumn("entity", F.col("entity") + 10), 1)
    assert spark.read.parquet(str(tmp_path / "cand")).where("i = 10 and j = 0").count() == 1


def test_sql_functions(spark):
    sqlapi.register(spark)
    assert spark.sql("select canonical_kmer('TTTT') as a, round(mash_distance(1D, 5), 3) as b").first()[:] == ("AAAA", 0.0)
    assert [tuple(r) for r in spark.sql("select * from kmers('ACGT', 3)").collect()] == [(1, "ACG"), (2, "CGT")]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTACGTTGCATGCATGACTGATCGATGCTAGCATCG\n>y\nACGTACGTTGCATGCATGACTGATCGATGCTAGCATCC\n")
    main(["sketch", "-k", "5", "-S", "16", "--parse-by-seq", "--topk", "1", "-o", str(tmp_path / "out"), str(tmp_path / "a.fa")])
    assert spark.read.parquet(str(tmp_path / "out/pairs")).count() == 2
    main(["cmp", "-k", "5", "-S", "16", "--greedy", "0.3", "-o", str(tmp_path / "cmp"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "cmp/clusters")).select("rep").distinct().count() == 1
