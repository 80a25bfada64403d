import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.config import Kind, SketchConfig, Space
from kinfold.functions import measures as M
from kinfold.operators import counting as C
from kinfold.operators import features as K
from kinfold.operators import filters as FL
from kinfold.operators import neighbours as N
from kinfold.operators import pairs as P
from kinfold.operators import sketches as S


def sets(spark, data):
    return spark.createDataFrame([(e, x) for e, xs in data.items() for x in xs], "entity bigint, item bigint")


def test_kmers_of_small_sequences(spark):
    df = spark.createDataFrame([(1, "ACGTACGTNN"), (2, "TTTTACGT"), (3, "AC"), (4, None), (5, "")], "entity int, seq string")
    got = K.kmers(df, "entity", "seq", 4).groupBy("entity").agg(F.count("*"), F.countDistinct("kmer")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 3), (2, 5, 5)]
    assert K.kmers(df, "entity", "seq", 4, canon=False).where("entity = 1").count() == 5


def test_canonical_is_invariant_under_reverse_complement(spark):
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(60))
    rc = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(1, seq), (2, rc)], "entity int, seq string")
    km = K.kmers(df, "entity", "seq", 7).groupBy("kmer").agg(F.countDistinct("entity").alias("n"))
    assert km.where("n <> 2").count() == 0


def test_spacing_and_window_longer_than_sequence(spark):
    assert K.spacing("0,1x2,0") == [0, 1, 3, 5, 6]
    df = spark.createDataFrame([(1, "ACGTTG")], "entity int, seq string")
    assert K.minimizers(K.kmers(df, "entity", "seq", 4), 50).count() == 1
    with pytest.raises(ValueError):
        K.kmers(df, "entity", "seq", 3, offsets=[0, 2])


def test_intervals_and_junctions(spark):
    iv = spark.createDataFrame([(1, "1", 10, 13), (1, "2", 0, 2), (1, "3", 4, 4)], "e int, c string, s bigint, t bigint")
    got = {r["item"] for r in K.interval_items(iv, "e", "c", "s", "t").collect()}
    assert got == {"1:10", "1:11", "1:12", "2:0", "2:1"}
    sp = spark.createDataFrame([("s1", "chr1:10:20:clu_1", 3, 5), ("s2", "chr1:10:20:clu_1", 0, 4)], "sample string, junction string, num bigint, den bigint")
    assert [tuple(r) for r in K.junction_items(sp).collect()] == [("s1", "1:10:20", 0.6)]


def test_cardinality_estimates(spark):
    for n in (2000, 20000):
        df = spark.range(n).select(F.lit(1).alias("entity"), F.col("id").alias("item"))
        for size in (128, 1024):
            est = S.cardinality(df, "item", size).first()["card"]
            assert abs(est - n) / n < 4 / math.sqrt(size)
        fast = S.setsketch_cardinality(S.setsketch_fast(df, "item", 256), 256).first()["card"]
        assert abs(fast - n) / n < 4 / 16


def test_merge_is_the_sketch_of_the_union(spark):
    a, b = range(0, 300), range(200, 500)
    both = S.oph(sets(spark, {1: a, 2: b}), "item", 64)
    merged = S.merge(both, spark.createDataFrame([(1, 9), (2, 9)], "entity bigint, g bigint"), "g")
    direct = S.oph(sets(spark, {9: range(500)}), "item", 64)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
    again = S.merge(both.unionByName(both), spark.createDataFrame([(1, 9), (2, 9)], "entity bigint, g bigint"), "g")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, direct.collect()))


def test_similarity_estimate_and_identity(spark):
    # a few of 512 buckets stay empty; empty registers count as equal once densified
    regs = S.densify(S.oph(sets(spark, {1: range(0, 3000), 2: range(1000, 4000), 3: range(0, 3000)}), "item", 512), 512)
    got = {(r["i"], r["j"]): r["eq"] / 512 for r in P.register_pairs(regs).collect()}
    assert got[1, 3] == 1.0
    assert abs(got[1, 2] - 0.5) < 4 * math.sqrt(0.25 / 512)
    pieces = {(r["i"], r["j"]): r["eq"] / 512 for r in P.register_pairs(regs, most=2).collect()}
    assert pieces == got


def test_pairs_that_share_only_big_buckets_are_found(spark):
    regs = S.oph(sets(spark, {i: range(40) for i in range(5)}), "item", 8)
    got = sorted(map(tuple, P.register_pairs(regs, most=2).collect()))
    assert got == [(i, j, 8) for i in range(5) for j in range(i + 1, 5)]


def test_bagminhash_of_fractional_weights(spark):
    """Weights below 1 count: collisions follow sum min / sum max."""
    rows = [(e, i, w) for i in range(400) for e, w in ((1, 0.5), (2, 0.25 + 0.5 * (i % 2)))]
    regs = S.bagminhash(spark.createDataFrame(rows, "entity bigint, item bigint, w double"), "item", "w", 256)
    eq = P.register_pairs(regs).first()["eq"]
    n = P.with_filled(P.register_pairs(regs), regs, 256).first()["filled"]
    assert abs(eq / n - 0.375 / 0.625) < 5 * math.sqrt(0.24 / n)


def test_densify_fills_and_empty_input(spark):
    regs = S.oph(sets(spark, {1: [1, 2, 3], 2: [1]}), "item", 16)
    assert S.densify(regs, 16).count() == 32
    assert S.densify(S.oph(sets(spark, {}), "item", 16), 16).count() == 0


def test_weighted_collisions(spark):
    rng = random.Random(3)
    rows = [(e, i, rng.randint(1, 9)) for e in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "entity bigint, item bigint, w bigint")
    x, y = {i: w for e, i, w in rows if e == 1}, {i: w for e, i, w in rows if e == 2}
    true = sum(min(x[i], y[i]) for i in x) / sum(max(x[i], y[i]) for i in x)
    for regs, size in ((S.bagminhash(df, "item", "w", 256), 256), (S.icws(df, "item", "w", 64), 64)):
        est = P.register_pairs(regs.select("entity", "reg", "v")).first()["eq"] / size
        assert abs(est - true) < 4 * math.sqrt(true * (1 - true) / size)


def test_topk_keeps_ties_and_filters(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.5), (1, 5, 0.1)], "i int, j int, s double")
    assert sorted(r["j"] for r in N.topk(e, "s", 2).collect()) == [2, 3, 4]
    assert FL.threshold(e, "s", 0.5).count() == 3 and FL.threshold(e, "s", 0.5, distance=True).count() == 1
    with pytest.raises(Exception, match="too small"):
        FL.require(e, "s > 0.2", "too small").collect()


def test_bloom_removes_all_blocked(spark):
    f = spark.range(500).select(F.lit(1).alias("entity"), F.col("id").alias("item"))
    left = FL.bloom_block(f, f.where("item < 200"), "item", bits=1 << 16)
    assert left.where("item < 200").count() == 0 and left.count() > 280


def test_greedy_clusters_equal_sequential(spark):
    rng = random.Random(5)
    n = 60
    edges = {(i, j): round(rng.random(), 3) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.1}
    reps, want = [], {}
    for v in range(n):
        near = [(-edges.get((min(v, r), max(v, r)), -1), r) for r in reps if (min(v, r), max(v, r)) in edges]
        want[v] = min(near)[1] if near else v
        if not near:
            reps.append(v)
    e = spark.createDataFrame([(i, j, s) for (i, j), s in edges.items()], "i bigint, j bigint, score double")
    order = spark.createDataFrame([(v, v) for v in range(n)], "entity bigint, pos bigint")
    assert {r["member"]: r["rep"] for r in N.greedy_clusters(e, order).collect()} == want


def test_edit_and_ml(spark):
    seqs = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 3]), (3, [])], "entity int, items array<int>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    assert {(r["i"], r["j"]): r["dist"] for r in P.sequence_edit(pairs, seqs).collect()} == {(1, 2): 1, (1, 3): 3}
    df = spark.createDataFrame([(25, 25, 50, 100.0, 100.0)], "gt int, lt int, eq int, a double, b double")
    assert 0.3 < P.joint_ml(df, 1.001).first()["j_ml"] < 0.6
    j = df.select(M.discrete_ml_similarity(F.lit(0.25), F.lit(0.25), F.col("a"), F.col("b")).alias("j")).first()["j"]
    assert abs(j - 0.5) < 1e-9


def test_counters(spark):
    df = sets(spark, {1: [5, 5, 6], 2: [6]})
    assert C.merge_counts(C.counts(df, "item"), C.counts(df, "item"), item="item").agg(F.sum("cnt")).first()[0] == 8
    assert C.bottom_k(C.exact_sets(df, "item"), "item", 10).count() == 3


def test_config():
    assert SketchConfig(21, space=Space.MULTISET).checked().kind is Kind.FULL
    assert not SketchConfig(21, alphabet="protein20").checked().canonical
    assert SketchConfig(21).key() != SketchConfig(22).key()
    with pytest.raises(ValueError):
        SketchConfig(21, space=Space.EDIT).allows(M.Measure.UNION)
    with pytest.raises(ValueError):
        SketchConfig(0).checked()
    assert N.default_candidates(100) == 10 and N.default_candidates(10**6) == 100
