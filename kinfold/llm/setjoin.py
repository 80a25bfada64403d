"""All pairs of similar sets by pigeonhole partitioning.

Two sets of sizes n <= m with Jaccard similarity t or more differ in at most
H = (1-t)/(1+t) * (n+m) tokens. The token universe is divided into segments whose number
depends on the length group of the smaller set. Give the smaller set an allowance of 1 or 2
in some of its segments, H + 1 in total: then in one of them the sets agree exactly, or
differ in one token at most. Equality is an equi-join on a segment's signature; a difference
of one token is one on the signatures with one token left out.

Allowance goes first to signatures that hold a token which is not very common, so that
their buckets are short. A set without enough of these also looks up its poorer signatures,
down to empty segments; those are indexed only when there is such a set. All signatures of
a batch of sets are computed at once. Candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of integers (the public splitmix64 finaliser)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapse equal sets. From ``rows [id, s, fp]`` (sorted set and its fingerprint):
    ``members [id, rep]`` and ``sets [rep, s]``, ``rep`` being the smallest id of a set. An
    id given with different sets keeps the one of the largest fingerprint."""
    one = rows.groupBy("id").agg(F.max("fp").alias("fp"))
    reps = one.groupBy("fp").agg(F.min("id").alias("rep"))
    members = one.join(reps, "fp").select("id", "rep")
    sets = rows.withColumnRenamed("id", "rep").join(reps, ["rep", "fp"]).dropDuplicates(["rep"]).drop("fp")
    return cut(members), cut(sets)


def expand(pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ids from pairs of representatives, plus the pairs of each set's copies."""
    blocks = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    part = members.join(blocks, "rep").withColumn("nb", F.ceil(F.col("n") / 1024).cast("int")).withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    part = cut(part.select("rep", "id", "n", "nb", "k"))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    many = part.where("n > 1")
    left = many.select("rep", F.col("k").alias("x"), every.alias("y"), F.col("id").alias("i"))
    right = many.select("rep", every.alias("x"), F.col("k").alias("y"), F.col("id").alias("j"))
    same = left.join(right, ["rep", "x", "y"]).where("i < j").select(F.col("i").alias(a), F.col("j").alias(b))
    ma, mb = members.select(F.col("rep").alias("a"), F.col("id").alias("i")), members.select(F.col("rep").alias("b"), F.col("id").alias("j"))
    across = pairs.select("a", "b").join(ma, "a").join(mb, "b").select(F.least("i", "j").alias(a), F.greatest("i", "j").alias(b))
    return across.unionByName(same)


def hot_tokens(sets: DataFrame, arr: str, most: int) -> DataFrame:
    """``sets`` with a column ``hot``: those of its tokens that are in over ``most`` sets."""
    flat = sets.select("rep", F.explode(arr).alias("t"))
    hot = cut(flat.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most))
    own = flat.join(hot, "t").groupBy("rep").agg(F.collect_list("t").alias("hot"))
    return cut(sets.join(own, "rep", "left"))


class _Plan:
    """Length groups, segment counts and error bounds for one similarity threshold."""

    def __init__(self, num: int, den: int, per_segment: float = 1.5, ratio: float = 1.2):
        self.t = Fraction(num, den)
        self.per_segment, self.ratio = per_segment, ratio
        self.low = [1]

    def reach(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.ratio)))

    def group(self, n: int) -> int:
        self.reach(n)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def high(self, g: int) -> int:
        self.reach(self.low[g] if g < len(self.low) else 10**6)
        return self.low[g + 1] - 1

    def segments(self, g: int) -> int:
        """At least half of the allowance that can be needed: each segment takes up to 2."""
        high = self.high(g)
        return max(1, round(high / self.per_segment), -(-(self.differ(high, self.largest(high)) + 1) // 2))

    def tables(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """First length and number of segments of each length group up to that of the
        longest set that can be similar to one of ``longest`` tokens."""
        last = self.group(self.largest(longest))
        return np.array(self.low[: last + 1]), np.array([self.segments(g) for g in range(last + 1)])

    def largest(self, n: int) -> int:
        return int(n / self.t)

    def smallest(self, n: int) -> int:
        return -int(-(n * self.t) // 1)

    def differ(self, n: int, m: int) -> int:
        return int((1 - self.t) / (1 + self.t) * (n + m))


_SALT = np.uint64(0xD1B54A32D192ED03)


def _key(total: np.ndarray, seg: np.ndarray, g: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(total + seg.astype(np.uint64) * _SALT + (g * 4 + kind).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


class _Cut:
    """Sets of a batch cut into segments: a row per segment (``row`` the set, ``g``, ``seg``,
    hash sum ``total``, number of tokens ``size`` and of rare ones ``r``, empty segments
    included where asked for) and per token (``at`` its segment, ``h``, ``rare``)."""

    def __init__(self, row: np.ndarray, tokens: np.ndarray, rare: np.ndarray, g: np.ndarray, m: np.ndarray, empty: bool):
        """``g``, ``m``: length group and number of segments by set, -1 and 0 for none."""
        kept = m[row] > 0
        row, tokens, rare = row[kept], tokens[kept], rare[kept]
        seg = (mix(tokens ^ (g[row] * 7919 + 13)) % m[row].astype(np.uint64)).astype(np.int64)
        base = np.cumsum(m) - m
        code = base[row] + seg
        order = np.argsort(code, kind="stable")
        code, self.h, self.rare = code[order], mix(tokens[order]), rare[order]
        if empty:
            used = np.arange(int(m.sum()))
            self.at = code
        else:
            used, self.at = np.unique(code, return_inverse=True)
        n = len(used)
        self.row = np.repeat(np.arange(len(m)), m)[used]
        self.seg, self.g = used - base[self.row], g[self.row]
        self.size = np.bincount(self.at, minlength=n)
        self.r = np.bincount(self.at, weights=self.rare, minlength=n).astype(np.int64)
        self.total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(self.total, self.at, self.h)

    def equal(self, kind: int) -> np.ndarray:
        return _key(self.total, self.seg, self.g, kind)

    def without_one(self, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _key(self.total[self.at] - self.h, self.seg[self.at], self.g[self.at], kind)


def probes(row: np.ndarray, tokens: np.ndarray, rare: np.ndarray, n: np.ndarray, plan: _Plan):
    """Signatures that sets look up: (key, set, length group from which it is needed,
    whether it may be poor). ``row`` is each token's set and ``n`` the size of each set."""
    low, parts = plan.tables(int(n.max()))
    g = np.searchsorted(low, n, side="right") - 1
    c = _Cut(row, tokens, rare, g, parts[g], True)
    many, r = c.size > 1, c.r
    # how poor a segment's signature is, for an allowance of 1 and for one more
    one = np.select([r > 1, r == 1, many, c.size == 1], [0, 1, 3, 4], 6)
    two = np.select([r > 1, (r == 1) & many, many, r == 1, c.size == 1], [0, 2, 3, 5, 7], 8)
    rank, seg = np.concatenate([one, two]), np.tile(np.arange(len(one)), 2)
    unit = np.repeat([0, 1], len(one))
    order = np.lexsort((unit, seg, -np.tile(r, 2), rank, c.row[seg]))
    rank, seg, unit = rank[order], seg[order], unit[order]
    owner = c.row[seg]
    first = np.searchsorted(owner, np.arange(len(n)))
    before = np.arange(len(owner)) - first[owner]  # the allowance that is given earlier
    since = np.full(len(owner), -1)
    share = (1 - plan.t) / (1 + plan.t)
    largest = n * plan.t.denominator // plan.t.numerator
    last = np.searchsorted(low, largest, side="right") - 1
    highs = np.append(low[1:] - 1, plan.high(len(low) - 1))
    for p in range(int((last - g).max()) + 1):
        q = np.minimum(g + p, len(low) - 1)
        need = (n + np.minimum(highs[q], largest)) * share.numerator // share.denominator + 1
        since = np.where((since < 0) & (before < need[owner]) & (g + p <= last)[owner], (g + p)[owner], since)
    given = np.full((2, len(c.row)), -1)
    given[unit, seg] = since
    poor = np.zeros((2, len(c.row)), bool)
    poor[unit, seg] = rank > 1
    a, b = np.flatnonzero(given[0] >= 0), np.flatnonzero(given[1] >= 0)
    t = np.flatnonzero(given[1][c.at] >= 0)
    at = c.at[t]
    keys = np.concatenate([c.equal(0)[a], c.equal(1)[b], c.without_one(0)[t]])
    return keys, np.concatenate([c.row[a], c.row[b], c.row[at]]), np.concatenate([given[0][a], given[1][b], given[1][at]]), np.concatenate([poor[0][a], poor[1][b], poor[1][at]])


def entries(row: np.ndarray, tokens: np.ndarray, rare: np.ndarray, n: np.ndarray, plan: _Plan, poor: bool):
    """Signatures under which sets are found by sets no larger than themselves: (key, set).
    Either the rich ones or, with ``poor``, all others."""
    low, parts = plan.tables(int(n.max()))
    top = np.searchsorted(low, n, side="right") - 1
    least = -(-n * plan.t.numerator // plan.t.denominator)
    bottom = np.searchsorted(low, np.maximum(1, least), side="right") - 1
    keys, rows = [], []
    for d in range(int((top - bottom).max()) + 1):
        g = np.where(bottom + d <= top, bottom + d, -1)
        c = _Cut(row, tokens, rare, g, np.where(g >= 0, parts[g], 0), poor)
        a = np.flatnonzero((c.r == 0) == poor)
        t = np.flatnonzero((c.r[c.at] - c.rare < 2) == poor)
        keys += [c.equal(0)[a], c.without_one(1)[t]]
        rows += [c.row[a], c.row[c.at[t]]]
    return np.concatenate(keys), np.concatenate(rows)


def _flat(b: pa.RecordBatch):
    """rep, each token's row, tokens, whether they are rare, set sizes of a batch."""
    rep = b.column(0).to_numpy()
    n = b.column(1).value_lengths().to_numpy().astype(np.int64)
    tokens = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rep)), n)
    hot = b.column(2)
    size = np.nan_to_num(hot.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    common = hot.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # (set, token) pairs as places in one sorted list, so that they compare exactly
    places = np.unique(np.concatenate([tokens, common]))
    code = lambda r, t: r * len(places) + np.searchsorted(places, t)
    return rep, row, tokens, ~np.isin(code(row, tokens), code(np.repeat(np.arange(len(rep)), size), common)), n


def similar_sets(df: DataFrame, id_col: str, set_col: str, num: int, den: int, common: int = 64) -> tuple[DataFrame, DataFrame]:
    """``pairs [a, b, shared, total]`` between distinct sets, a < b, with a Jaccard
    similarity (shared/total) of ``num/den`` or more, and ``members [id, rep]``.

    ``set_col`` is an array of integers; null and repeated elements are ignored. Rows with
    a null id, a null array or no element are in no pair. Equal sets are compared once:
    ``rep`` is the smallest id with that set, and ``expand`` spells the copies out. An id
    given twice counts once. Other columns are not read; an empty table gives no rows.
    ``common`` is the number of sets above which a token counts as very common; it changes
    the work, not the result.
    """
    plan = _Plan(num, den)
    s = F.array_sort(F.array_distinct(F.array_compact(F.col(set_col).cast("array<bigint>"))))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), s.alias("s")).where(F.size("s") > 0)
    members, sets = classes(rows.withColumn("fp", F.md5(F.array_join(F.col("s").cast("array<string>"), ","))))
    sets = hot_tokens(sets, "s", common)
    pairs = candidates(sets, plan)
    return verified(pairs, sets, num, den), members


def candidates(sets: DataFrame, plan: _Plan) -> DataFrame:
    """``[a, b]``: every pair of ``sets [rep, s, hot]`` that can be similar, and others."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                rep, row, tokens, rare, n = _flat(whole.slice(lo, 512))
                k, x, since, poor = probes(row, tokens, rare, n, plan)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(rep[x]), pa.array(n[x].astype(np.int32)), pa.array(since.astype(np.int32)), pa.array(poor)], ["k", "x", "nx", "since", "poor"])

    def indexed(poor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    rep, row, tokens, rare, n = _flat(whole.slice(lo, 512))
                    low = plan.tables(int(n.max()))[0]
                    k, y = entries(row, tokens, rare, n, plan, poor)
                    g = (np.searchsorted(low, n, side="right") - 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(rep[y]), pa.array(n[y].astype(np.int32)), pa.array(g[y])], ["k", "y", "ny", "gy"])

        return run

    src = spread(sets.select("rep", "s", "hot"))
    left = cut(src.mapInArrow(looked_up, "k bigint, x bigint, nx int, since int, poor boolean"))
    fits = (F.col("x") != F.col("y")) & (F.col("ny") >= F.col("nx")) & (F.col("nx") * plan.t.denominator >= F.col("ny") * plan.t.numerator) & (F.col("gy") >= F.col("since"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    right = "k bigint, y bigint, ny int, gy int"
    found = left.join(src.mapInArrow(indexed(False), right), "k").where(fits).select(*pair)
    short = left.where("poor")
    if not short.isEmpty():
        found = found.unionByName(short.join(src.mapInArrow(indexed(True), right), "k").where(fits).select(*pair))
    return found.distinct()


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    sa, sb = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    shared: Column = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(sa, "a").join(sb, "b").select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("sum"))
    return cut(both.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") * den >= F.col("total") * num))
