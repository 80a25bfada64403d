"""Similarity clusters of vectors: neighbour descent, modularity communities, cliques.

1. Neighbour descent. Random rotations seed each vector with neighbours that share its
   nearest signed axes; then every vector introduces its neighbours to each other, and the
   best k survive, until hardly anything changes.
2. Communities. On the links above the threshold, vertices move to the neighbouring
   community with the largest modularity gain; communities are contracted and moved again.
3. Exact check. The cosines inside a community are recomputed from the doubles; a community
   in which not all members are similar is divided into cliques, members with the highest
   internal weighted degree first. That takes one task for a community of up to 512 members;
   of a larger one, tiles of pairs are computed apart and cliques are taken off in rounds.
4. Union. Cliques that share a link, or whose centres are neighbours, are compared exactly
   and united where all their members are similar, until nothing can be united.

Equal vectors are one vertex throughout, so copies cost nothing until the result is spelled
out. Every step works on keyed runs of bounded length; no large community is collected.
Typical members are found without pairs: a member's internal weighted degree is the product
of its unit vector and the sum of all of its cluster's.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, mark, parallelism, spread
from .components import components, union_all
from .vectors import binaries, dimension, distinct_vectors, packed

_RUN = 512  # rows of one key that are compared with each other at once


def _runs(batches: Iterator[pa.RecordBatch], work: Callable, schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Feed ``work(rep, vectors, extra)`` with the rows of each key of a sorted partition.

    A key may span batches. Rows of a key beyond ``_RUN`` are compared in windows that
    overlap by half, so memory stays bounded; their order, and so the windows, should
    differ from key to key.
    """
    key, held = None, []

    def columns(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        out: list = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if keys[lo] != key:
                if held:
                    out += work(columns(held))
                key, held = keys[lo], []
            held.append(b.slice(lo, hi - lo))
            while sum(x.num_rows for x in held) > _RUN:
                rows = columns(held)
                out += work(rows.slice(0, _RUN))
                held = [rows.slice(_RUN // 2)]
        if out:
            yield _emit(out, schema)
    if held and (out := work(columns(held))):
        yield _emit(out, schema)


def _emit(parts: list, schema: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema)


def _compare(dims: int, k: int, floor: float) -> Callable:
    """Among the rows (key, rep, code) of one key: each row's k best partners."""

    def work(b: pa.RecordBatch) -> list:
        if b.num_rows < 2:
            return []
        rep = b.column(1).to_numpy()
        x = packed(b.column(2), "i1", dims).astype(np.float32)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        g = x @ x.T
        g[rep[:, None] == rep[None, :]] = -2
        if g.shape[1] > k:
            kth = np.partition(g, -k, axis=1)[:, -k]
            i, j = np.nonzero(g >= np.maximum(kth, floor)[:, None])
        else:
            i, j = np.nonzero(g >= floor)
        return [(rep[i], rep[j], g[i, j].astype(np.float64))] if len(i) else []

    return work


def _keep(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each vertex, each partner once."""
    best = pairs.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("r") <= k).drop("r")


def neighbour_graph(vectors: DataFrame, dims: int, k: int = 16, floor: float = 0.6, tables: int = 24, rounds: int = 12, settled: float = 0.005, seed: int = 7) -> DataFrame:
    """``[a, b, s]``: approximately the k most similar vertices of each vertex (cosine of
    int8 codes, at least ``floor``), from ``vectors [rep, unit]``, by neighbour descent: it
    ends when a round renews at most the share ``settled`` of the links."""
    spark = vectors.sparkSession
    n = vectors.count()
    hashes = max(1, math.ceil(math.log(max(n, 2) / 16) / math.log(2 * dims))) if n > 16 else 1

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = packed(b.column(1), "<f8", dims)
            q = np.rint(u / np.abs(u).max(axis=1, keepdims=True, initial=1e-300) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), binaries(q)], ["rep", "q"])

    coded = cut(spread(vectors.select("rep", "unit")).mapInArrow(codes, "rep bigint, q binary"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        turn = rng.standard_normal((tables * hashes, dims, dims)).astype(np.float32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                x = packed(b.column(1), "i1", dims).astype(np.float32)
                for t in range(tables):
                    key = np.full(len(x), t, np.int64)
                    for h in range(hashes):
                        y = x @ turn[t * hashes + h]
                        axis = np.abs(y).argmax(axis=1)
                        key = key * (2 * dims) + 2 * axis + (y[np.arange(len(y)), axis] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], ["key", "rep", "q"])

    parts = parallelism(spark)
    pair = "a bigint, b bigint, s double"
    compare = _compare(dims, k, floor)

    def within(keyed: DataFrame) -> DataFrame:
        return keyed.repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("key", "rep")).mapInArrow(lambda it: _runs(it, compare, ["a", "b", "s"]), pair)

    graph = cut(_keep(within(spread(coded).mapInArrow(seeds, "key bigint, rep bigint, q binary")).withColumn("new", F.lit(1)), k))
    for _ in range(rounds):
        back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "new")
        around = _keep(graph.unionByName(back), 2 * k)
        fresh = around.groupBy("a").agg(F.max("new").alias("m")).where("m = 1").select("a")
        hoods = around.join(fresh, "a").select(F.col("a").alias("key"), F.col("b").alias("rep")).join(coded, "rep").select("key", "rep", "q")
        met = within(hoods).withColumn("new", F.lit(1))
        # a pair that was known keeps new = 0, so that it starts no further introduction
        graph = cut(_keep(union_all([graph.withColumn("new", F.lit(0)), back.withColumn("new", F.lit(0)), met]), k))
        changed = graph.agg(F.sum("new"), F.count(F.lit(1))).first()
        if (changed[0] or 0) <= settled * (changed[1] or 1):
            break
    return graph.select("a", "b", "s")


def communities(edges: DataFrame, moves: int = 8) -> DataFrame:
    """``[id, community]`` of the vertices of ``edges [a, b]`` (undirected, each once), by
    modularity: local moving with unit weights, then contraction, until nothing merges.

    All vertices move at once; two single vertices swap places only towards the smaller
    label, and equal gains go to the smaller label. After ``moves`` rounds at most, what has
    come together is contracted and goes on moving as one, level after level.
    """
    work = edges.select("a", "b", F.lit(1.0).alias("w"))
    member = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("community", F.col("id"))
    total = None
    for level in itertools.count():
        both = mark(work.where("a <> b").select(F.explode(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))).alias("e")).select("e.*"))
        if both.isEmpty():  # every community is cut off from the others
            break
        degree = both.groupBy("a").agg(F.sum("w").alias("d"))
        if level:
            loops = work.where("a = b").select("a", (2 * F.col("w")).alias("l"))
            degree = degree.join(loops, "a", "left").select("a", (F.col("d") + F.coalesce("l", F.lit(0.0))).alias("d"))
        else:
            total = both.agg(F.sum("w")).first()[0]
        label = mark(degree.select("a", "d", F.col("a").alias("c"), F.lit(False).alias("m")))
        for _ in range(moves):
            label = mark(_move(both, label, total))
            if label.where("m").isEmpty():
                break
        sizes = label.agg(F.count(F.lit(1)), F.countDistinct("c")).first()
        if sizes[0] == sizes[1]:  # nothing came together
            break
        step = label.select(F.col("a").alias("community"), F.col("c").alias("next"))
        member = mark(member.join(step, "community", "left").select("id", F.coalesce("next", "community").alias("community")))
        la, lb = label.select("a", F.col("c").alias("ca")), label.select(F.col("a").alias("b"), F.col("c").alias("cb"))
        inner = both.where("a < b").join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        kept = work.where("a = b").join(la, "a").select(F.col("ca").alias("a"), F.col("ca").alias("b"), "w") if level else None
        work = inner if kept is None else inner.unionByName(kept).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return member


def _move(both: DataFrame, label: DataFrame, total: float) -> DataFrame:
    """One round of local moving: ``[a, d, c, m]``, m telling who changed community c."""
    mass = label.groupBy("c").agg(F.sum("d").alias("t"), F.count(F.lit(1)).alias("n"))
    state = label.select("a", "d", "c").join(mass, "c").select("a", "d", "c", "n", "t")
    to = state.select(F.col("a").alias("b"), F.col("c").alias("bc"), F.col("t").alias("bt"), F.col("n").alias("bn"))
    pull = both.join(to, "b").groupBy("a", "bc").agg(F.sum("w").alias("in"), F.first("bt").alias("bt"), F.first("bn").alias("bn"))
    own = F.col("bc") == F.col("c")
    # weights are whole numbers, so sums and gains are the same in whatever order
    gain = F.col("in") - F.col("d") * (F.col("bt") - F.when(own, F.col("d")).otherwise(0.0)) / total
    stay = F.coalesce(F.max(F.when(own, F.col("g"))), F.lit(0.0))
    allowed = ~own & ((F.col("n") > 1) | (F.col("bn") > 1) | (F.col("bc") < F.col("c")))
    best = F.max(F.when(allowed, F.struct(F.col("g"), (-F.col("bc")).alias("neg"))))
    choice = pull.join(state, "a").withColumn("g", gain).groupBy("a", "d", "c").agg(stay.alias("stay"), best.alias("best"))
    moved = F.coalesce((F.col("best.g") > F.col("stay")) & (F.col("best.g") > 0), F.lit(False))
    return choice.select("a", "d", F.when(moved, -F.col("best.neg")).otherwise(F.col("c")).alias("c"), moved.alias("m"))


def _inner_pairs(members: DataFrame, vectors: DataFrame, dims: int, least: float) -> DataFrame:
    """``[c, a, b, sim]``: exact cosines of at least ``least`` inside each community.

    Small communities are packed many to a task; a large one is divided into blocks whose
    pairs are tiles of bounded size.
    """
    spark = members.sparkSession
    size = members.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / _RUN).cast("int")
    placed = members.join(size.where("n > 1").select("c", blocks.alias("nb")), "c").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    placed = placed.select("c", "rep", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    placed = placed.select("c", "rep", "blk", F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"))
    placed = placed.join(vectors.select("rep", "unit"), "rep").select("c", "ti", "tj", "blk", "rep", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush(rows: list[pa.RecordBatch]) -> list:
            t = pa.Table.from_batches(rows)
            c, ti, tj, blk, rep = (t.column(i).to_numpy() for i in range(5))
            u = packed(t.column(5), "<f8", dims)
            x, y = np.flatnonzero(blk == ti[0]), np.flatnonzero(blk == tj[0])
            out = []
            for lo in range(0, len(x), 1024):
                part = x[lo : lo + 1024]
                s = np.round(u[part] @ u[y].T, 9)
                i, j = np.nonzero(s >= least)
                a, b, v = rep[part[i]], rep[y[j]], s[i, j]
                ok = a < b if ti[0] == tj[0] else np.ones(len(a), bool)
                out.append((np.full(ok.sum(), c[0]), np.minimum(a, b)[ok], np.maximum(a, b)[ok], v[ok]))
            return out

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
            out: list = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key is None or (k[lo] != key).any():
                    if held:
                        out += flush(held)
                    key, held = k[lo], []
                held.append(b.slice(lo, hi - lo))
            if out:
                yield _emit(out, ["c", "a", "b", "sim"])
        if held and (out := flush(held)):
            yield _emit(out, ["c", "a", "b", "sim"])

    keyed = placed.repartition(parallelism(spark), "c", "ti", "tj").sortWithinPartitions("c", "ti", "tj")
    return keyed.mapInArrow(run, "c bigint, a bigint, b bigint, sim double")


def _cliques(members: DataFrame, inner: DataFrame) -> DataFrame:
    """``[cluster, rep]``: each community divided into groups of mutually linked members.

    A member stays with its community's leading members when it is linked to every member
    of higher rank (internal weighted degree, then the smaller id); these form a clique. The
    others are ranked anew, round after round. A community that is a clique takes one round.
    """
    size = members.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("cluster"))
    links = inner.groupBy("c").agg(F.count(F.lit(1)).alias("e"))
    whole = size.join(links, "c", "left").withColumn("clean", F.coalesce("e", F.lit(0)) * 2 == F.col("n") * (F.col("n") - 1))
    done = [mark(members.join(whole.where("clean").select("c", "cluster"), "c").select("cluster", "rep"))]
    rest = mark(members.join(whole.where("not clean").select("c"), "c").select("c", "rep"))
    while not rest.isEmpty():
        live = rest.select("rep")
        edges = inner.join(live.withColumnRenamed("rep", "a"), "a").join(live.withColumnRenamed("rep", "b"), "b")
        both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        weight = both.groupBy("a").agg(F.sum("sim").alias("w"))
        ranked = rest.join(weight, rest["rep"] == weight["a"], "left").select("c", "rep", F.coalesce("w", F.lit(0.0)).alias("w"))
        by = Window.partitionBy("c").orderBy(F.desc("w"), "rep")
        ranked = mark(ranked.select("c", "rep", F.row_number().over(by).alias("r")))
        ra, rb = ranked.select(F.col("rep").alias("a"), F.col("r").alias("x")), ranked.select(F.col("rep").alias("b"), F.col("r").alias("y"))
        above = both.join(ra, "a").join(rb, "b").where("y < x").groupBy("a").agg(F.count(F.lit(1)).alias("h"))
        judged = mark(ranked.join(above, ranked["rep"] == above["a"], "left").select("c", "rep", "r", (F.coalesce("h", F.lit(0)) == F.col("r") - 1).alias("ok")))
        lead = judged.where("r = 1").select("c", F.col("rep").alias("cluster"))
        done.append(judged.where("ok").join(lead, "c").select("cluster", "rep"))
        rest = mark(judged.where("not ok").select("c", "rep"))
    return union_all(done)


def _divided(members: DataFrame, vectors: DataFrame, dims: int, least: float) -> DataFrame:
    """``[to, g]``: the atoms g of each community united into cliques, named by one of them.

    ``members [c, g, rep]``: community, atom (a clique already) and vector. Two atoms are
    linked when all of their members are similar, by the sum of their cosines; cliques are
    taken off as ``_cliques`` does.
    """
    members = cut(members)
    size = members.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    few, many = size.where(F.col("n") <= _RUN).select("c"), size.where(F.col("n") > _RUN).select("c")
    keyed = members.join(few, "c").join(vectors.select("rep", "unit"), "rep").select("c", "g", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            c, g = t.column(0).to_numpy(), t.column(1).to_numpy()
            u = packed(t.column(2), "<f8", dims)
            edges = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            out = [_taken(g[lo:hi], u[lo:hi], least) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["to", "g"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            keys = t.column(0).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last community may go on
            if whole:
                yield flush(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    small = keyed.repartition(parallelism(members.sparkSession), "c").sortWithinPartitions("c").mapInArrow(run, "to bigint, g bigint")
    if many.isEmpty():
        return cut(small)
    large = cut(members.join(many, "c"))
    pairs = _inner_pairs(large.select("c", "rep"), vectors, dims, least)
    ga, gb = large.select(F.col("rep").alias("a"), F.col("g").alias("ga")), large.select(F.col("rep").alias("b"), F.col("g").alias("gb"))
    between = pairs.join(ga, "a").join(gb, "b").where("ga <> gb").groupBy("c", F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count(F.lit(1)).alias("e"), F.sum("sim").alias("sim"))
    n = large.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    na, nb = n.select(F.col("g").alias("a"), F.col("n").alias("na")), n.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    linked = cut(between.join(na, "a").join(nb, "b").where("e = na * nb").select("c", "a", "b", "sim"))
    taken = _cliques(large.select("c", F.col("g").alias("rep")).distinct(), linked)
    return cut(small.unionByName(taken.select(F.col("cluster").alias("to"), F.col("rep").alias("g"))))


def _taken(g: np.ndarray, u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """One community of ``_divided``: (clique, atom) of each atom."""
    atoms, at = np.unique(g, return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(atoms)))
    s = np.round(u[order] @ u[order].T, 9)
    block = lambda m, f: f.reduceat(f.reduceat(m, first, axis=0), first, axis=1)
    linked = block(s, np.minimum) >= least
    weight = np.where(linked, block(s, np.add), 0.0)
    to, live = np.zeros(len(atoms), np.int64), np.arange(len(atoms))
    while len(live):
        inner = weight[np.ix_(live, live)]
        rank = live[np.lexsort((atoms[live], -np.round(inner.sum(axis=1) - np.diag(inner), 6)))]
        m = linked[np.ix_(rank, rank)] | np.tri(len(rank), dtype=bool).T
        ok = m.all(axis=1)
        to[rank[ok]] = atoms[rank[0]]
        live = rank[~ok]
    return to, atoms


def _centres(groups: DataFrame, vectors: DataFrame, dims: int, whole: bool = False) -> DataFrame:
    """``[rep, unit]``: each cluster and the mean of its members' unit vectors, or with
    ``whole`` their sum, each as often as ``m`` of ``groups [cluster, rep, m]`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n = None, np.zeros(dims), 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, u, m = b.column(0).to_numpy(), packed(b.column(1), "<f8", dims), b.column(2).to_numpy()
            u = u * m[:, None]
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            ids, means = [], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if keys[lo] != key:
                    if n:
                        ids.append(key)
                        means.append(total / (1 if whole else n))
                    key, total, n = keys[lo], np.zeros(dims), 0
                total, n = total + u[lo:hi].sum(axis=0), n + int(m[lo:hi].sum())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), binaries(np.array(means, "<f8"))], ["rep", "unit"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), binaries((total / (1 if whole else n))[None, :].astype("<f8"))], ["rep", "unit"])

    keyed = groups.join(vectors, "rep").select("cluster", "unit", F.col("m").cast("bigint").alias("m")).repartition(parallelism(groups.sparkSession), "cluster").sortWithinPartitions("cluster")
    return keyed.mapInArrow(run, "rep bigint, unit binary")


def _united(groups: DataFrame, links: DataFrame, vectors: DataFrame, dims: int, least: float, graph_k: int) -> DataFrame:
    """``groups [cluster, rep]`` with cliques united that are one clique together.

    Candidates are cliques that share a link and cliques with neighbouring centres; the
    product of two centres is the mean of all cosines across, which must reach ``least``.
    All cliques that hang together by candidates are then compared exactly. Every round
    unites some cliques, or is the last.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = packed(b.column(2), "<f8", dims), packed(b.column(3), "<f8", dims)
            ok = (x * y).sum(axis=1) >= least - 1e-8
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in range(2)], ["a", "b"])

    while True:
        centres = cut(_centres(groups.withColumn("m", F.lit(1)), vectors, dims))
        near = neighbour_graph(centres, dims, k=graph_k, floor=max(0.0, least - 0.03)).select("a", "b")
        ga, gb = groups.select(F.col("rep").alias("a"), F.col("cluster").alias("ca")), groups.select(F.col("rep").alias("b"), F.col("cluster").alias("cb"))
        across = links.join(ga, "a").join(gb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        asked = across.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        asked = asked.join(centres.select(F.col("rep").alias("a"), F.col("unit").alias("x")), "a").join(centres.select(F.col("rep").alias("b"), F.col("unit").alias("y")), "b")
        asked = cut(asked.select("a", "b", "x", "y").mapInArrow(close, "a bigint, b bigint"))
        if asked.isEmpty():
            return groups
        parts = components(asked, "a", "b").select(F.col("group_id").alias("c"), F.col("record_id").alias("cluster"))
        to = _divided(groups.join(parts, "cluster").select("c", F.col("cluster").alias("g"), "rep"), vectors, dims, least)
        if to.where("to <> g").isEmpty():
            return groups
        groups = cut(groups.join(to.withColumnRenamed("g", "cluster"), "cluster", "left").select(F.coalesce("to", "cluster").alias("cluster"), "rep"))


def clusters(df: DataFrame, id_col: str, vec: str, least: float = 0.85, typical: int = 3, graph_k: int = 16) -> tuple[DataFrame, DataFrame]:
    """``members [cluster, entity]`` and ``summary [cluster, size, typical]``.

    Every entity with a vector is in exactly one cluster, possibly alone, and within a
    cluster each pair has a cosine of ``least`` or more (rounded to 9 decimals). ``cluster``
    is the smallest entity id in it; ``typical`` lists the ``typical`` members of highest
    internal weighted degree, ties to the smaller id. Null and NaN registers count as 0; an
    entity without vector, or with only zeros, is in no cluster; an entity given twice
    counts once; other columns are not read; an empty table gives no rows. The graph is
    approximate, so a pair may be missed; no pair below ``least`` is ever joined.
    """
    spark = df.sparkSession
    dims = dimension(df, vec)
    if not dims:
        return spark.createDataFrame([], "cluster bigint, entity bigint"), spark.createDataFrame([], "cluster bigint, size bigint, typical array<bigint>")
    entities, vectors = distinct_vectors(df, id_col, vec, None, 1, dims)
    graph = neighbour_graph(vectors, dims, k=graph_k, floor=max(0.0, least - 0.25))
    # int8 codes err by 0.03 at most here; the exact check follows
    links = graph.where(F.col("s") >= least - 0.03).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(links)
    found = cut(communities(links).select(F.col("id").alias("rep"), F.col("community").alias("c")))
    groups = _divided(found.select("c", F.col("rep").alias("g"), "rep"), vectors, dims, least).select(F.col("to").alias("cluster"), F.col("g").alias("rep"))
    alone = vectors.select("rep").join(groups.select("rep"), "rep", "left_anti").select(F.col("rep").alias("cluster"), "rep")
    groups = _united(cut(groups.unionByName(alone)), links, vectors, dims, least, graph_k)
    first = groups.groupBy("cluster").agg(F.min("rep").alias("low"))
    groups = cut(groups.join(first, "cluster").select(F.col("low").alias("cluster"), "rep"))
    members = cut(groups.join(entities.select("id", "rep"), "rep").select("cluster", F.col("id").alias("entity"), "rep"))
    copies = entities.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # the sum holds the member itself once
            w = (packed(b.column(1), "<f8", dims) * packed(b.column(2), "<f8", dims)).sum(axis=1) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(w, 6))], ["rep", "w"])

    total = _centres(groups.join(copies, "rep"), vectors, dims, whole=True).select(F.col("rep").alias("cluster"), F.col("unit").alias("sum"))
    degree = groups.join(total, "cluster").join(vectors.select("rep", "unit"), "rep").select("rep", "unit", "sum").mapInArrow(degrees, "rep bigint, w double")
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "entity"))
    best = members.join(degree, "rep").withColumn("r", order).where(F.col("r") <= typical)
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]).alias("typical"))
    return members.select("cluster", "entity"), size.join(names, "cluster").select("cluster", "size", "typical")


def same_cluster_pairs(members: DataFrame) -> DataFrame:
    """``[entity_a, entity_b]``: every pair of one cluster, smaller id first. The result
    itself has that many rows; large clusters are joined in blocks by their size."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", F.ceil(F.col("n") / 1024).cast("int").alias("nb"))
    part = members.join(size, "cluster").withColumn("blk", F.pmod(F.xxhash64("entity"), F.col("nb")).cast("int"))
    left = part.select("cluster", F.col("blk").alias("ba"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"), F.col("entity").alias("entity_a"))
    right = part.select("cluster", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("ba"), F.col("blk").alias("bb"), F.col("entity").alias("entity_b"))
    return left.join(right, ["cluster", "ba", "bb"]).where("entity_a < entity_b").select("entity_a", "entity_b")
