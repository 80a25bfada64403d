"""Encoding, packing, subjects, counts and components."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinfold.llm import bpe, components, heavy_hitters, markup, packing, subjects


def reference():
    with open(bpe.VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark):
    ref, rng = reference(), random.Random(6)
    letters = [chr(c) for c in range(32, 127)] + list("éß中😀́  \x1c٣Ⅷ½\n\t\r   '''")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(600)]
    texts += ["a" * 30_000, " " * 5000 + "x", "<|endoftext|>", "don't we'll 12345", "\\frac{\\alpha}{2}" * 300]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(9000, "", [0]), (9001, None, None), (None, "a", None)], "doc bigint, txt string, ids array<int>")
    got = {r["doc"]: r["ids"] for r in bpe.encode_texts(df, "doc", "txt").collect()}
    assert got[9000] == got[9001] == [] and got[None] == ref.encode_ordinary("a")
    for i, t in enumerate(texts):
        assert got[i] == ref.encode_ordinary(t), repr(t[:80])
    n = {r["doc"]: r["n_tokens"] for r in bpe.count_tokens(df, "doc", "txt").collect()}
    assert all(n[i] == len(got[i]) for i in range(len(texts))) and n[9001] == 0


def test_packing_keeps_limits_and_splits_only_long_items(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([rng.randint(1, 60), rng.randint(40, 100), rng.randint(1, 350)]) for i in range(900)}
    rows = [(i, n, 1, n - 1) for i, n in sizes.items()] + [(2000, 0, 1, 0), (2001, None, 1, 0), (5, 3, 1, 2)]
    df = spark.createDataFrame(rows, "doc bigint, n bigint, seg bigint, loss bigint")
    out = packing.pack(df, "doc", ["n", "seg", "loss"], [100, 12, 100], shard_items=200)
    got = out.collect()
    full: dict[int, list[int]] = {}
    for r in got:
        c = full.setdefault(r["container_id"], [0, 0, 0])
        for k, v in enumerate((r["n"], r["seg"], r["loss"])):
            c[k] += v
    assert all(a <= 100 and b <= 12 and c <= 100 for a, b, c in full.values())
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r["doc"], []).append(r["n"])
    assert 2000 not in by and 2001 not in by
    for i, n in sizes.items():
        total = n + (3 if i == 5 else 0)
        assert sum(by[i]) == total
        if i != 5:
            assert len(by[i]) == -(-n // 100)
    total = sum(r["n"] for r in got)
    assert len(full) <= total / 100 * 1.03 + 1
    with pytest.raises(ValueError, match="exceeds"):
        packing.pack(spark.createDataFrame([(1, 5, 99)], "doc bigint, n bigint, seg bigint"), "doc", ["n", "seg"], [100, 12])
    assert packing.pack(df.where("n < 0"), "doc", ["n", "seg", "loss"], [100, 12, 100]).count() == 0


def test_one_shard_is_packed_well():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 4096, (2000, 1))
    bins = packing.pack_shard(sizes, np.array([4096]))
    assert np.bincount(bins, sizes[:, 0]).max() <= 4096
    assert bins.max() + 1 <= np.ceil(sizes.sum() / 4096) * 1.02


def test_heavy_hitters(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2, 2, 3, rng.randint(10, 500)]), rng.randint(1, 4)) for i in range(1500)]
    rows += rows[::5] + [(5000, None, 9), (5001, 1, None), (None, 8, 100), (None, 8, 100)]
    df = spark.createDataFrame(rows, "obs bigint, v bigint, c int").withColumn("total", F.lit(1)).withColumn("o", F.lit(2))
    want: dict[int, int] = {}
    for o, v, c in {(o, v, c) for o, v, c in rows if o is not None} | set():
        if v is not None and c is not None:
            want[v] = want.get(v, 0) + c
    want[8] = want.get(8, 0) + 200
    assert {r["v"]: r["total"] for r in heavy_hitters.value_totals(df, "v", "c", "obs").collect()} == want
    top = heavy_hitters.top_values(df, "v", "c", 7, "obs").orderBy("rk").collect()
    assert [(r["v"], r["total"]) for r in top] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
    total = sum(want.values())
    got = {r["v"] for r in heavy_hitters.frequent_values(df, "v", "c", 2, 100, "obs").collect()}
    assert got == {v for v, n in want.items() if n * 100 >= 2 * total}
    assert heavy_hitters.frequent_values(df.limit(0), "v", "c", 2, 100, "obs").count() == 0
    with pytest.raises(ValueError):
        heavy_hitters.top_values(df, "v", "c", 0)


def joined(pairs):
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "grid"])
def test_components(spark, shape):
    rng = random.Random(9)
    pairs = {
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)],
        "chain": [(i, i + 1) for i in rng.sample(range(300), 300)],
        "star": [(777, i) for i in range(200)] + [(i, i + 1000) for i in range(200)],
        "grid": [(i, i + 1) for i in range(99) if i % 10 < 9] + [(i, i + 10) for i in range(90)],
    }[shape]
    rows = pairs + [(b, a) for a, b in pairs[::3]] + [(5, 5), (None, 3), (4, None)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "x bigint, y bigint, s int, t int")
    got = [tuple(r) for r in components.components(df, "x", "y").select("record_id", "group_id").collect()]
    assert len(got) == len(set(got)) and dict(got) == joined((a, b) for a, b in pairs if a != b)


def test_links_and_no_links(spark):
    df = spark.createDataFrame([(1, [2, -1, 1, 3, 4], [0.5, None, 0.9, 0.0, None]), (5, None, None), (6, [], []), (7, [8], [0.1])], "row_id bigint, indices array<bigint>, data array<float>")
    assert sorted(map(tuple, components.neighbour_links(df).collect())) == [(1, 2), (7, 8)]
    assert components.components(components.neighbour_links(df.limit(0)), "row_id", "other").count() == 0


TEX = r"""% preamble with quark
\documentclass{article}
\newcommand{\xTerm}{dark halo\xspace}
\def\yTerm{neutron star}
\title{On the \xTerm}
\author{A.~Nobody}
\begin{document}
The \yTerm{} shines. \emph{Gas}~cloud $x = y$ and 5\% of \cite{hidden}. % secret
\iffalse
never shown
\fi
\begin{comment}
also hidden
\end{comment}
\begin{figure}\includegraphics{pic}\caption{Caf\'e light}\end{figure}
\begin{thebibliography}{1}
\bibitem{a} Listed work.
\end{thebibliography}
\end{document}
After the end."""


def test_running_text():
    t = markup.running_text(TEX)
    for kept in ("dark halo", "neutron star", "Gas cloud", "Café light", "5"):
        assert kept in t
    for gone in ("quark", "Nobody", "hidden", "secret", "never", "Listed", "After", "pic", "x = y"):
        assert gone not in t
    assert markup.running_text(None) == markup.running_text("") == markup.running_text(" \r\n﻿") == ""
    assert markup.running_text(TEX.replace("\n", "\r\n")) == t
    assert "shines" in markup.running_text(TEX[: TEX.index("% secret")])
    assert "visible" in markup.running_text("visible \\iffalse broken off")
    assert len(markup.running_text("word " * 100_000)) > 400_000


def made_up(rng, terms, classes, n):
    docs, labels = [], []
    for i in range(n):
        own = rng.sample(classes, 1 if rng.random() < 0.8 else 2)
        lines = [f"The {rng.choice(terms[rng.choice(own)])} of the sample is large." for _ in range(16)]
        docs.append((i, "\n\n".join(lines), "x", None))
        labels += [(i, c) for c in own]
    return docs, labels


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(3)
    classes = [f"class_{c}" for c in "abcd"]
    terms = {c: [f"{c[-1]}word{j} {c[-1]}thing" if i % 2 else f"{c[-1]}solo{j}" for i, j in enumerate("abcdefghijkl")] for c in classes}
    docs, labels = made_up(rng, terms, classes, 300)
    extra = [(1000, None, "", None), (1001, "", "", None), (1002, "The large sample of the sample is large.\n\nNothing else is here.", "", None), (docs[0][0], docs[0][1], "", None)]
    frame = spark.createDataFrame(docs + extra, "doc_id bigint, text string, subject string, classes string")
    given = [(i, c.upper().replace("_", "-") if i % 3 else f" {c} ") for i, c in labels if i < 150]
    lab = spark.createDataFrame(given + given[:5] + [(3, "unknown"), (None, "class_a")], "doc_id bigint, subject string")
    subs = spark.createDataFrame([(c, c, "") for c in classes], "subject string, title string, scope string")
    model = subjects.fit(frame, lab, subs)
    got = [tuple(r) for r in subjects.document_subjects(frame, model).collect()]
    assert len(got) == len(set(got)) and not {i for i, _ in got} & {1000, 1001, 1002}
    want = {x for x in labels if x[0] >= 150}
    held = {x for x in got if 150 <= x[0] < 1000}
    assert len(held & want) / len(held) > 0.97 and len(held & want) / len(want) > 0.93
    empty = subjects.fit(frame, lab.limit(0), subs)
    assert subjects.document_subjects(frame, empty).count() == 0


def test_awkward_items_end_the_rounds(spark):
    """Items of three quarters of a container: none can be saved, and none may be lost."""
    items = spark.range(600).select(F.col("id"), F.lit(75).alias("n"))
    out = packing.pack(items, "id", ["n"], [100], shard_items=50)
    assert out.count() == 600 == out.select("container_id").distinct().count()


def test_negative_counts_fail(spark):
    df = spark.createDataFrame([(1, 5), (1, -4)], "v bigint, c bigint")
    with pytest.raises(Exception, match="negative count"):
        heavy_hitters.frequent_values(df, "v", "c", 1, 10).collect()


def test_subjects_of_one_labelled_document_each(spark):
    texts = ["Radio jet and radio jet. " * 4 + "The radio jet is near the molecular cloud.", "A prime and an elliptic curve. " * 4 + "The elliptic curve of a prime."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["We see a radio jet. The radio jet moves.", "", None])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, "Stars"), (1, "numbers")], "doc_id bigint, subject string")
    names = spark.createDataFrame([(x, x) for x in ["stars", "numbers", *"abcdefgh"]], "subject string, title string")
    got = {tuple(r) for r in subjects.document_subjects(docs, subjects.fit(docs, labels, names)).collect()}
    assert {(0, "stars"), (1, "numbers"), (2, "stars")} <= got and {i for i, _ in got} <= {0, 1, 2}


def test_only_labelled_texts_are_shuffled(spark):
    """Texts that no label refers to stay where they are read, whatever the size of the tables."""
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.random()) for _ in range(1000))) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, "A"), (0, "a"), (1, "b"), (1, "A"), (7, "unknown"), (900, "b")], "doc_id bigint, subject string")
    names = spark.createDataFrame([("a",), ("b",)], "subject string")
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, sc.statusStore().__getattr__("stageList$default$4")(), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts, subs = subjects.labelled_sample(docs, labels, names, 20_000)
        got = sorted(map(tuple, texts.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(0, rows[0][1], ["a"]), (1, rows[1][1], ["a", "b"])] and subs == ["a", "b"]
    assert written() - before < 200_000


def test_reading_compiles_no_pattern_for_a_text(monkeypatch):
    import re

    markup.running_text(TEX)
    made, real = [], re._compiler.compile
    monkeypatch.setattr(re._compiler, "compile", lambda *a: made.append(a) or real(*a))
    t = "\\def\\xy{an \\zw{} end}\\newcommand{\\zw}{odd}\\begin{document}See \\xy\\ here, \\xyz\\ \\xy{} 5\\% \\\\% gone\n there \\zw.\\end{document}"
    assert markup.running_text(t).split() == "See an odd end here, an odd end 5 there odd".split() and not made


def test_threshold_needs_no_texts(spark):
    model = subjects.SubjectModel(["a", "b"], np.array([0.5, 0.5]), {"en": {("red",): np.array([0.9, 0.1]), ("blue",): np.array([0.1, 0.9])}})
    rows = [("en", "the red one\nit is red", ["a"]), ("en", "the blue one", ["b"]), ("en", "", ["a"])]
    assert subjects._calibrated(spark.createDataFrame(rows, "lang string, words string, classes array<string>"), model, {"a": 0, "b": 1}) == 0.17


def test_shares_follow_their_definition():
    rng = np.random.default_rng(3)
    prior = np.array([0.5, 0.3, 0.2])
    grams = [("a",), ("b",), ("c",), ("a", "b"), ("c", "d", "e"), ("f", "a")]
    single = {g: rng.dirichlet(prior) for g in grams}
    double = {tuple(sorted((x, y))): rng.dirichlet(prior / 4) for x in grams for y in grams if x < y and rng.random() < 0.6}
    model = subjects.SubjectModel(["x", "y", "z"], prior, {"en": single}, {"en": double})
    for _ in range(50):
        sentences = [[*rng.choice(list("abcdefg"), rng.integers(1, 25))] for _ in range(4)]
        odds = []
        for s in sentences:
            found, at = [], 0
            while at < len(s):
                n = next((n for n in (4, 3, 2, 1) if at + n <= len(s) and tuple(s[at : at + n]) in single), 0)
                found += [tuple(s[at : at + n])] if n else []
                at += max(n, 1)
            sure = [single[g] for g in found]
            for i in range(len(found)):
                for j in range(i + 1, min(i - i % 6 + 6, len(found))):
                    p = double.get(tuple(sorted((found[i], found[j]))))
                    for k in (i, j) if p is not None else ():
                        sure[k] = p if p.max() > sure[k].max() else sure[k]
            odds += [p / prior for p in sure]
        share = np.full(3, 1 / 3)
        for _ in range(15):
            r = np.array(odds) * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(model.shares_of("en", sentences), share, rtol=0, atol=1e-12)
