"""Queries without SQL on fixtures that a cut of their candidates would leave out."""

import pytest

from kinfold.plans import registry


def test_joint_ml_has_every_overlapping_pair(spark, tmp_path):
    sets = {1: range(5), 2: range(5), 3: range(4, 30), 4: range(100, 120), 5: range(111, 140)}
    rows = [(e, i, 1.0) for e, items in sets.items() for i in items]
    spark.createDataFrame(rows, "row_id bigint, item bigint, weight double").write.parquet(f"{tmp_path}/fx_csr.parquet")
    got = {(r["i"], r["j"]): r["j_ml"] for r in registry.csr_joint_ml(spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for i in sets for j in sets if i < j and set(sets[i]) & set(sets[j])}
    assert got[1, 2] > 0.99


def test_minimizer_edit_has_short_reads(spark, tmp_path):
    short, other = "ACGTTGCATTAGCCA", "GGATCCATTTGACAGTTCAA"
    rows = [(1, short), (2, short), (3, other), (4, other + "T"), (5, "ACG")]
    spark.createDataFrame(rows, "seq_id bigint, seq string").write.parquet(f"{tmp_path}/fx_sequences.parquet")
    got = {(r["i"], r["j"]): r["dist"] for r in registry.seq_minimizer_edit(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (3, 4)} and got[1, 2] == 0


def test_short_documents_are_near_duplicates_too(spark, tmp_path):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (3, text + " eight"), (4, "nothing of the kind is said in here"), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["i"], r["j"]): r["score"] for r in registry.doc_threshold_graph(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 1.0}
    near = {(r["i"], r["j"]): r["score"] for r in registry.doc_nearest_topk(spark, str(tmp_path)).collect()}
    assert near[1, 2] == 1.0 and near[1, 3] > 0.5


def test_refined_neighbours_have_recall(spark):
    d = "/root/testdata/sf0.01"
    exact = {(r["i"], r["j"]) for r in registry.csr_exact_knn(spark, d).collect()}
    found = {(r["i"], r["j"]) for r in registry.csr_knn_refined(spark, d).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_positional_broadcasts_no_minimizers(spark):
    df = registry.seq_positional(spark, "/root/testdata/sf0.001")
    assert not _broadcasts(df)


def test_positional_counts_runs_and_repeats(spark):
    from kinfold.operators import pairs

    items = {1: [7] * 70 + [8, 7], 2: [7] * 66 + [9] * 4 + [8, 8], 3: [9] * 72}
    rows = [(e, p, x) for e, xs in items.items() for p, x in enumerate(xs, 1)]
    got = {(r["i"], r["j"]): r["matches"] for r in pairs.positional(spark.createDataFrame(rows, "entity int, pos int, h int"), "h").collect()}
    assert got == {(1, 2): 67, (2, 3): 4}


def _broadcast_features(df):
    """Broadcasts of the first plan that hold exploded rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((k for k, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    found = []
    for k, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((m for m in range(k + 1, len(lines)) if depth[m] <= depth[k]), len(lines))
            found += [x for y in lines[k:end] if "Generate" in y]
    return found


def test_edit_distance_broadcasts_no_kmers(spark):
    assert not _broadcast_features(registry.seq_edit_distance(spark, "/root/testdata/sf0.001"))


def test_minimizer_edit_broadcasts_no_items(spark):
    assert not _broadcast_features(registry.seq_minimizer_edit(spark, "/root/testdata/sf0.001"))


def test_refined_neighbours_join_items_once(spark):
    plan = registry.csr_knn_refined(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3  # of rows by their item, and of the sizes


def test_near_duplicates_broadcast_no_shingles(spark):
    assert not _broadcast_features(registry.doc_threshold_graph(spark, "/root/testdata/sf0.001"))


def test_likely_pairs_are_all_there(spark):
    import random

    from kinfold.operators import pairs

    rng = random.Random(7)
    docs = {e: {r: e // 3 for r in rng.sample(range(32), rng.choice((1, 2, 5, 20, 32)))} for e in range(60)}
    for e, regs in docs.items():
        regs.update({r: rng.choice((e, -1)) for r in list(regs) if rng.random() < 0.3})
    rows = [(e, r, v) for e, regs in docs.items() for r, v in regs.items()]
    got = {tuple(r) for r in pairs.likely_pairs(spark.createDataFrame(rows, "entity int, reg int, v long"), 32, 0.8, 2).collect()}
    want = set()
    for i in docs:
        for j in docs:
            eq, n = sum(docs[j].get(r) == v for r, v in docs[i].items()), len(set(docs[i]) | set(docs[j]))
            want |= {(i, j)} if i < j and eq and eq >= 0.8 * n - 2 * n**0.5 else set()
    assert want and got == want


def test_nearest_documents_read_texts_once(spark):
    plan = registry.doc_nearest_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "array_join" not in plan


def test_containment_shuffles_no_pairs(spark):
    plan = registry.file_containment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[query" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("cell", [4_000_000, 50])
def test_containment_in_cells_equals_brute_force(spark, monkeypatch, cell):
    import random

    from kinfold.operators import neighbours

    monkeypatch.setattr(neighbours, "_CELL", cell)
    rng = random.Random(5)
    asked = [(None if e == 9 else e, rng.choice(["hot", "x", *map(str, range(30))])) for e in range(40) for _ in range(12)] + [(3, None), (50, "none")]
    held = [(f"r{e}", x) for e in range(30) for x in ["hot", "hot", "own" + str(e), *map(str, rng.sample(range(30), e % 7))]] + [("r1", None), (None, "hot"), ("alone", "y")]
    got = neighbours.containment(spark.createDataFrame(asked, "entity int, i string"), spark.createDataFrame(held, "ref string, i string"), "i", digits=3).collect()
    want = {}
    for q in {a for a, _ in asked}:
        for r in {a for a, _ in held} - {None}:
            has = {x for a, x in held if a == r and x}
            n = [x for a, x in asked if a == q and x in has]
            if n:
                want[q, r] = (float(f"{len(set(n)) / len(has) + 1e-9:.3f}"), len(n) / len(set(n)))
    assert len(got) == len(want) and {(r["query"], r["ref"]): (r["coverage"], r["mean_depth"]) for r in got} == want


def test_shares_are_rounded_as_by_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from kinfold.operators.neighbours import _half_up

    x = [a / b for b in (1, 3, 7, 123, 1024, 2048, 3072, 5120) for a in range(1, b + 1)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert _half_up(np.array(x), 9).tolist() == want
