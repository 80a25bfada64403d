"""Pair operators against brute force, with nulls, copies, ties and clashing columns."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import overlaps, setjoin, sketchjoin


def near_sets(rng, n, common):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            s = set(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                if s and rng.random() < 0.5:
                    s.discard(rng.choice(sorted(s)))
                s.add(rng.randint(100, 10**9))
        else:
            s = {rng.randint(100, 10**9) for _ in range(rng.randint(1, 40))} | set(rng.sample(range(20), rng.randint(0, common)))
        out.append(s)
    return out


def similar(sets, num, den):
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


@pytest.mark.parametrize(("num", "den", "common", "most"), [(3, 5, 6, 5), (3, 5, 18, 3), (1, 2, 3, 64), (9, 10, 12, 4)])
def test_similar_sets_equal_brute_force(spark, num, den, common, most):
    rng = random.Random(num * 100 + common)
    sets = dict(enumerate(near_sets(rng, 160, common)))
    rows = [(i, list(s) + [None] + list(s)[:2], "x", 0) for i, s in sets.items()]
    rows += [(0, list(sets[0]), "again", 1), (900, [], "", 0), (901, None, None, 0), (902, [None], "", 0), (None, [1, 2], "", 0)]
    df = spark.createDataFrame(rows, "id bigint, k array<bigint>, rep string, s int")
    pairs, members = setjoin.similar_sets(df, "id", "k", num, den, common=most)
    got = [tuple(r) for r in setjoin.expand(pairs, members, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == similar(sets, num, den)


@pytest.mark.parametrize(("num", "den"), [(3, 5), (1, 2), (9, 10)])
def test_probe_meets_index_within_the_bound(num, den):
    """Whichever tokens are rare, a similar pair shares a signature of the right group."""
    plan = setjoin._Plan(num, den)

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.sets(st.integers(0, 5000), min_size=1, max_size=40), st.sets(st.integers(0, 5000), max_size=12), st.sets(st.integers(0, 39), max_size=10), st.integers(0, 5000))
    def check(x, more, less, hot):
        y = (x | more) - {v for i, v in enumerate(sorted(x)) if i in less}
        if not y or len(x & y) * den < len(x | y) * num or x == y:
            return
        a, b = (np.array(sorted(v)) for v in sorted((x, y), key=len))
        one = lambda v: (np.zeros(len(v), int), v, v >= hot, np.array([len(v)]))
        keys, _, since, poor = setjoin.probes(*one(a), plan)
        g = plan.group(len(b))
        rich, rest = set(setjoin.entries(*one(b), plan, False)[0].tolist()), set(setjoin.entries(*one(b), plan, True)[0].tolist())
        need = since <= g
        assert set(keys[need].tolist()) & rich or set(keys[need & poor].tolist()) & rest

    check()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, k array<bigint>, t string")
    pairs, members = setjoin.similar_sets(none, "id", "k", 3, 5)
    assert setjoin.expand(pairs, members, "a", "b").count() == 0
    pairs, members = sketchjoin.similar_sequences(none, "id", "t", 12, 1, 2)
    assert setjoin.expand(pairs, members, "a", "b").count() == 0
    pairs, members = overlaps.set_overlaps(spark.createDataFrame([], "r bigint, i bigint, w double, b int"), "r", "i", "w", "b", 3, 10)
    assert setjoin.expand(pairs, members, "a", "b").count() == 0


def kmer_set(text, k):
    s = "".join(c for c in text if c not in " \t\r\n\v\f").upper()
    comp = str.maketrans("ACGT", "TGCA")
    return {min(w, w.translate(comp)[::-1]) for i in range(len(s) - k + 1) if set(w := s[i : i + k]) <= set("ACGT")}


def test_similar_sequences_equal_brute_force(spark):
    rng = random.Random(8)
    adapter = "".join(rng.choice("ACGT") for _ in range(40))
    texts = {}
    for i in range(150):
        if texts and rng.random() < 0.6:
            t = list(texts[rng.choice(sorted(texts))].upper())
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice("ACGT")
            t = "".join(t)
            t = t if rng.random() < 0.7 else t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        else:
            t = "".join(rng.choice("ACGT") for _ in range(rng.randint(14, 200))) + (adapter if rng.random() < 0.5 else "")
        texts[i] = t
    texts[3] = texts[3].lower()
    texts[4] = " " + texts[4][:20] + "\r\n" + texts[4][20:] + "N"
    texts[5] = adapter
    texts[6] = adapter + "ACG"
    rows = [(i, t, 1) for i, t in texts.items()] + [(7, texts[7], 2), (500, None, 0), (501, "", 0), (502, "ACGT", 0), (503, "NNNNNNNNNNNNNNNNN", 0), (504, "é" * 30, 0)]
    df = spark.createDataFrame(rows, "id bigint, q string, n int")
    sets = {i: kmer_set(t, 12) for i, t in texts.items()}
    for most in (128, 6):
        pairs, members = sketchjoin.similar_sequences(df, "id", "q", 12, 1, 2, common=most)
        got = [tuple(r) for r in setjoin.expand(pairs, members, "a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == similar(sets, 1, 2)


def test_overlaps_equal_brute_force_and_changes_keep_counts(spark):
    rng = random.Random(2)
    sets = dict(enumerate(near_sets(rng, 120, 15)))
    sets[200] = set(range(10))
    sets[201] = set(range(10)) | {77}
    sets[202] = set(sets[3])
    rows = [(i, v, rng.choice([None, 1.0, 2.5]), rng.randint(0, 3)) for i, s in sets.items() for v in s]
    rows += [(i, v, w, 4) for i, v, w, _ in rows[::7]] + [(0, 55555, 0.0, 0), (None, 1, 1.0, 0), (1, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "row bigint, item bigint, n double, sign int")
    want = {(a, b) for x, a in enumerate(sorted(sets)) for b in sorted(sets)[x + 1 :] if len(sets[a] & sets[b]) * 10 >= 3 * min(len(sets[a]), len(sets[b]))}
    for most in (64, 4):
        pairs, members = overlaps.set_overlaps(df, "row", "item", "n", "sign", 3, 10, most)
        got = [tuple(r) for r in setjoin.expand(pairs, members, "a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_joins_and_leaves(spark, tmp_path):
    """Three change sets and a merge; every second one continues from the stored state."""
    state = overlaps.PairCounts.open(spark, f"{tmp_path}/state", most=3, buckets=3)
    have: dict[int, set[int]] = {i: set() for i in range(8)}
    rng = random.Random(4)
    for step in range(4):
        changes = []
        for i in have:
            for v in range(12):
                if rng.random() < 0.3:
                    changes.append((i, v, -1 if v in have[i] else 1))
                    have[i] ^= {v}
        state = state.apply(spark.createDataFrame(changes, "row bigint, item bigint, sign int"), merge_at=3)
        if step % 2:
            state = overlaps.PairCounts.open(spark, f"{tmp_path}/state")
            assert (state.most, state.buckets) == (3, 3)
        common = {r[0] for r in state.common.collect()}
        want = {(a, b): n for a in have for b in have if a < b and (n := len((have[a] & have[b]) - common))}
        assert {(r["a"], r["b"]): r["n"] for r in state.pairs.collect()} == want
        assert state.members.agg(F.count("*")).first()[0] == sum(map(len, have.values()))


def test_a_small_change_reads_its_buckets_only(spark, tmp_path):
    state = overlaps.PairCounts.open(spark, f"{tmp_path}/state", buckets=8)
    rows = [(i, v, 1) for i in range(20) for v in range(50)]
    state = state.apply(spark.createDataFrame(rows, "row bigint, item bigint, sign int"))
    plan = state._log().where(F.col("b").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "b#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    state = state.apply(spark.createDataFrame([(0, 7, -1), (99, 8, 1)], "row bigint, item bigint, sign int"))
    n = {(r["a"], r["b"]): r["n"] for r in state.pairs.collect()}
    assert n[0, 1] == 49 and n[1, 2] == 50 and n[5, 99] == 1
