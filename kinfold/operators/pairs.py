"""Pairs of sketches and of exact sets.

``shared`` frames come from an inverted index, that is an equi-join on (register, value) or
on the feature, so only pairs that share something are formed. Dense forms that list every
pair are for results that are dense by definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. The planner takes exploded features to be as small as
    the table they came from, so it would send them to the driver and broadcast them."""
    return df.hint("merge")


def register_pairs(regs: DataFrame, value: str = "v", most: int = 4096) -> DataFrame:
    """``[i, j, eq]``, i < j: number of equal registers, where there are any.

    A (register, value) bucket of more than ``most`` entities is cut into pieces of that
    size on one side and repeated for each on the other, so that it is no single task; all
    pairs are found whatever ``most`` is."""
    base = regs.select("entity", "reg", F.col(value).alias("v"))
    big = base.groupBy("reg", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("reg", "v", F.ceil(F.col("n") / most).cast("int").alias("k"))
    cut = base.join(big, ["reg", "v"], "left")
    one = F.coalesce(F.pmod(F.xxhash64("entity"), F.col("k")).cast("int"), F.lit(0)).alias("s")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k") - 1, F.lit(0)))).alias("s")
    left, right = cut.select(F.col("entity").alias("i"), "reg", "v", one), cut.select(F.col("entity").alias("j"), "reg", "v", every)
    return shuffled(left).join(right, ["reg", "v", "s"]).where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("eq"))


def likely_pairs(regs: DataFrame, size: int, share: float, errors: float) -> DataFrame:
    """``[i, j]``, i < j, whose equal registers are at least ``share`` of the filled ones less
    ``errors`` times their root. A pair fills as many registers as either side at least, so
    it has one in common among each side's rarest that may not all differ."""
    need = lambda n: share * n - errors * F.sqrt(n)
    regs = regs.select("entity", "reg", "v")
    often = regs.groupBy("reg", "v").agg(F.count(F.lit(1)).alias("f"))
    by = Window.partitionBy("entity")
    src = shuffled(regs).join(often.where("f > 1"), ["reg", "v"], "left").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy(F.coalesce("f", F.lit(1)), "reg")))
    rare = src.where((F.col("r") <= F.col("n") + 1 - F.greatest(F.ceil(need(F.col("n")) - 1e-9), F.lit(1))) & F.col("f").isNotNull())
    pairs = register_pairs(rare).select("i", "j")
    sig = regs.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("reg", "v"))).alias("m"))
    sig = sig.select("entity", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i.cast("int"))).alias("sig"))
    left, right = sig.select(F.col("entity").alias("i"), F.col("sig").alias("x")), sig.select(F.col("entity").alias("j"), F.col("sig").alias("y"))
    count = lambda f: F.aggregate(F.zip_with("x", "y", lambda p, q: F.when(f(p, q), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    both = shuffled(shuffled(pairs).join(left, "i")).join(right, "j")
    seen = both.select("i", "j", count(lambda p, q: p == q).alias("eq"), count(lambda p, q: p.isNotNull() | q.isNotNull()).alias("filled"))
    return seen.where(F.col("eq") >= need(F.col("filled"))).select("i", "j")


def with_filled(pairs: DataFrame, regs: DataFrame, size: int) -> DataFrame:
    """Adds ``filled``: how many registers are filled on either side. The equal share of
    these estimates the Jaccard similarity without bias, for short entities too."""
    words = [F.bit_or(F.when(F.floor(F.col("reg") / 32) == w, F.expr("shiftleft(1L, reg % 32)")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in range(-(-size // 32))]
    mask = regs.groupBy("entity").agg(*words).select("entity", F.array(*[f"m{w}" for w in range(len(words))]).alias("m"))
    a, b = mask.select(F.col("entity").alias("i"), F.col("m").alias("ma")), mask.select(F.col("entity").alias("j"), F.col("m").alias("mb"))
    n = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda t, x: t + x)
    return shuffled(shuffled(pairs).join(a, "i")).join(b, "j").withColumn("filled", n).drop("ma", "mb")


def shared_items(sets: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """``[i, j, shared(, wmin, dot)]``, i < j, of exact sets or count dictionaries."""
    cols = [F.col(item).alias("x")] + ([F.col(weight).alias("w")] if weight else [])
    left, right = sets.select(F.col("entity").alias("i"), *cols), sets.select(F.col("entity").alias("j"), *cols)
    if not weight:
        return left.join(right, "x").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"))
    met = left.withColumnRenamed("w", "wi").join(right.withColumnRenamed("w", "wj"), "x").where("i < j")
    return met.groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.least("wi", "wj")).alias("wmin"), F.sum(F.col("wi") * F.col("wj")).alias("dot"))


def with_sizes(pairs: DataFrame, sizes: DataFrame, size: str) -> DataFrame:
    """Adds ``a`` and ``b``, the two sides' ``size``."""
    a, b = sizes.select(F.col("entity").alias("i"), F.col(size).alias("a")), sizes.select(F.col("entity").alias("j"), F.col(size).alias("b"))
    return shuffled(shuffled(pairs).join(a, "i")).join(b, "j")


def positional(seqs: DataFrame, item: str) -> DataFrame:
    """``[i, j, matches]``: equal items at equal positions of ``[entity, pos, <item>]``, where
    a position has one item. An item's positions in a run of 64 are one row with a mask."""
    bit = F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")
    rows = seqs.groupBy("entity", F.floor(F.col("pos") / 64).alias("run"), F.col(item).alias("x")).agg(F.bit_or(bit).alias("m"))
    left, right = rows.select(F.col("entity").alias("i"), "run", "x", F.col("m").alias("mi")), rows.select(F.col("entity").alias("j"), "run", "x", F.col("m").alias("mj"))
    met = shuffled(left).join(right, ["run", "x"]).where("i < j and (mi & mj) <> 0")
    return met.groupBy("i", "j").agg(F.sum(F.expr("bit_count(mi & mj)")).alias("matches"))


def all_pairs(ids: DataFrame, scored: DataFrame, score: str, fill: float = 0.0) -> DataFrame:
    """The complete upper triangle ``[i, j, value]``: dense by definition, meant for the
    matrix sinks; ``scored [i, j, score]`` holds the pairs that are not ``fill``."""
    i, j = ids.select(F.col("entity").alias("i")), ids.select(F.col("entity").alias("j"))
    return i.join(j, F.col("i") < F.col("j")).join(scored, ["i", "j"], "left").select("i", "j", F.coalesce(score, F.lit(fill)).alias("value"))


def panel(refs: DataFrame, queries: DataFrame, value: str = "v") -> DataFrame:
    """``[i, j, eq]`` for references i and queries j that share a register."""
    left = refs.select(F.col("entity").alias("i"), "reg", F.col(value).alias("v"))
    right = queries.select(F.col("entity").alias("j"), "reg", F.col(value).alias("v"))
    return left.join(right, ["reg", "v"]).groupBy("i", "j").agg(F.count(F.lit(1)).alias("eq"))


def listed(pairs: DataFrame, regs: DataFrame, value: str = "v") -> DataFrame:
    """``[i, j, eq]`` for an explicit pair list ``[i, j]``, repeated pairs once, 0 included."""
    want = pairs.select("i", "j").distinct()
    left = regs.select(F.col("entity").alias("i"), "reg", F.col(value).alias("x"))
    right = regs.select(F.col("entity").alias("j"), "reg", F.col(value).alias("y"))
    got = want.join(left, "i").join(right, ["j", "reg"]).where("x = y").groupBy("i", "j").agg(F.count(F.lit(1)).alias("eq"))
    return want.join(got, ["i", "j"], "left").select("i", "j", F.coalesce("eq", F.lit(0)).alias("eq"))


def compare_arrays(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``[i, j, gt, lt, eq]`` of register arrays ``[entity, sig]`` for a pair frame."""
    count = lambda f: F.aggregate(F.zip_with("x", "y", lambda p, q: F.when(f(p, q), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    left, right = sketches.select(F.col("entity").alias("i"), F.col("sig").alias("x")), sketches.select(F.col("entity").alias("j"), F.col("sig").alias("y"))
    both = pairs.join(left, "i").join(right, "j")
    return both.select("i", "j", count(lambda p, q: p > q).alias("gt"), count(lambda p, q: p < q).alias("lt"), count(lambda p, q: p == q).alias("eq"))


def joint_ml(df: DataFrame, base: float) -> DataFrame:
    """Adds ``j_ml`` to ``[.., gt, lt, eq, a, b]``: the Jaccard similarity of greatest joint
    likelihood for discrete registers of the given base, by golden-section search on
    [0, min(a, b)/max(a, b)], vectorised over rows."""
    cols = [c for c in df.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gt, lt, eq, a, b = (f[c].to_numpy(float) for c in ("gt", "lt", "eq", "a", "b"))
            u, v = a / np.maximum(a + b, 1e-300), b / np.maximum(a + b, 1e-300)
            p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

            def loss(j):
                up, down = p(u - v * j), p(v - u * j)
                safe = lambda x: np.log(np.maximum(x, 1e-300))
                return -(gt * safe(up) + lt * safe(down) + eq * safe(1 - up - down))

            lo, hi = np.zeros(len(f)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-300)
            g = (np.sqrt(5) - 1) / 2
            for _ in range(60):
                c, d = hi - g * (hi - lo), lo + g * (hi - lo)
                left = loss(c) < loss(d)
                hi, lo = np.where(left, d, hi), np.where(left, lo, c)
            yield f.assign(j_ml=(lo + hi) / 2)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", j_ml double"
    return df.select(*cols).mapInPandas(run, schema)


def sequence_edit(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """``[i, j, dist, similarity]``: edit distance of item arrays ``[entity, items]``, and
    the longer length minus it. Arrow batches; one vectorised row of the table at a time."""
    left, right = seqs.select(F.col("entity").alias("i"), F.col("items").alias("x")), seqs.select(F.col("entity").alias("j"), F.col("items").alias("y"))
    both = shuffled(shuffled(pairs.select("i", "j")).join(left, "i")).join(right, "j")
    kind = both.schema["i"].dataType.simpleString()

    def dist(x, y) -> int:
        x, y = np.asarray(x), np.asarray(y)
        if not len(x) or not len(y):
            return max(len(x), len(y))
        at = np.arange(len(y) + 1)
        row = at.copy()
        for k, c in enumerate(x, 1):
            new = np.concatenate([[k], np.minimum(row[1:] + 1, row[:-1] + (y != c))])
            row = np.minimum.accumulate(new - at) + at
        return int(row[-1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d = [dist(x, y) for x, y in zip(f["x"], f["y"], strict=True)]
            m = [max(len(x), len(y)) for x, y in zip(f["x"], f["y"], strict=True)]
            yield pd.DataFrame({"i": f["i"], "j": f["j"], "dist": d, "similarity": [p - q for p, q in zip(m, d, strict=True)]})

    return both.mapInPandas(run, f"i {kind}, j {kind}, dist int, similarity int")


def cosine(pairs: DataFrame, vectors: DataFrame, vec: str) -> DataFrame:
    """``[i, j, cosine]`` of array columns; a zero vector has cosine 0 with anything."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    src = vectors.withColumn("n", norm)
    left, right = src.select(F.col("entity").alias("i"), F.col(vec).alias("x"), F.col("n").alias("p")), src.select(F.col("entity").alias("j"), F.col(vec).alias("y"), F.col("n").alias("q"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return pairs.join(left, "i").join(right, "j").select("i", "j", F.when(F.col("p") * F.col("q") > 0, dot / (F.col("p") * F.col("q"))).otherwise(0.0).alias("cosine"))
