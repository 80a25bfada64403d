"""Near-duplicate sequences by bottom-k sketches.

One hash function orders the k-mers of every sequence; its k smallest hash values are its
sketch, k being as large as the threshold needs for the lists to be complete (half of a
sequence's values and a few, at a similarity of one half). Inverted lists of the retained
values give each pair's overlap; what the union of two sketches says about the overlap of
the sets drops pairs that cannot be similar; what is left is verified on all k-mers.

Values in very many sketches (adapters, boilerplate) come last in the order, so that they
are retained only by sequences that consist of them largely. Lists that are long all the
same are cut into pieces for joining.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .setjoin import classes, mix


def _codes() -> np.ndarray:
    """Byte to base: A, C, G, T as 0 to 3 in either case, 5 for blanks, 4 for the rest."""
    t = np.full(256, 4, np.uint8)
    for i, base in enumerate(b"ACGT"):
        t[base] = t[base + 32] = i
    for blank in b" \t\n\v\f\r":
        t[blank] = 5
    return t


_BASE = _codes()


def canonical_kmers(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which text, and which canonical k-mer code, once per distinct k-mer, in order.

    Blanks and line ends are removed first, case is ignored, and a k-mer with a letter
    other than A, C, G or T is left out. k is at most 31."""
    data = [(t or "").encode("utf-8") + b"|" for t in texts]
    flat = _BASE[np.frombuffer(b"".join(data), np.uint8)]
    owner = np.repeat(np.arange(len(data)), [len(x) for x in data])
    kept = flat != 5
    flat, owner = flat[kept], owner[kept]
    n = len(flat) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(flat > 3)])
    fwd, rev = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        c = flat[j : j + n].astype(np.int64)
        fwd = (fwd << 2) | c
        rev |= (3 - c) << (2 * j)
    ok = bad[k:] == bad[:-k]
    who, code = owner[:n][ok], np.minimum(fwd[ok], rev[ok])
    order = np.lexsort((code, who))
    who, code = who[order], code[order]
    first = np.ones(len(who), bool)
    first[1:] = (who[1:] != who[:-1]) | (code[1:] != code[:-1])
    return who[first], code[first]


def _order(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hash values in the order of all sketches: those of very common values last."""
    late = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
    return h[np.lexsort((h, late))]


def retained(n: int, num: int, den: int, meet: int, size: int | None) -> int:
    """How many of a set's n values its sketch keeps: two sets of a similarity of at least
    num/den share ``meet`` of the kept values (or all that they must share, if fewer)."""
    least = -(-n * num // den)
    return min(n, n - least + min(meet, least), *([size] if size else []))


def _prepare(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    src = df.where(F.col(id_col).isNotNull() & F.col(seq_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                who, code = canonical_kmers(b.column(1).to_pylist(), k)
                ends = np.searchsorted(who, np.arange(b.num_rows + 1))
                n = np.diff(ends)
                fp = [hashlib.blake2b(code[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in range(b.num_rows)]
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in (b.column(0), pa.array(fp, pa.binary()), b.column(1))], ["id", "fp", "t"])

    return src.mapInArrow(run, "id bigint, fp binary, t string")


def _sketches(sets: DataFrame, k: int, keep, hot: bool) -> DataFrame:
    """``[rep, n, v]``: the retained values of each set, from ``sets [rep, t(, hot)]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                reps = b.column(0).to_numpy()
                who, code = canonical_kmers(b.column(1).to_pylist(), k)
                h = (mix(code) >> np.uint64(1)).astype(np.int64)
                ends = np.searchsorted(who, np.arange(b.num_rows + 1))
                n = np.diff(ends)
                late = b.column(2).to_pylist() if hot else [None] * b.num_rows
                lists = [_order(h[ends[i] : ends[i + 1]], np.asarray(late[i] or [], np.int64))[: keep(int(n[i]))] for i in range(b.num_rows)]
                size = [len(x) for x in lists]
                cols = [pa.array(np.repeat(reps, size)), pa.array(np.repeat(n, size).astype(np.int32)), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "n", "v"])

    return sets.mapInArrow(run, "rep bigint, n int, v bigint")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    ta, tb = sets.select(F.col("rep").alias("a"), F.col("t").alias("ta")), sets.select(F.col("rep").alias("b"), F.col("t").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                n = b.num_rows
                who, code = canonical_kmers(b.column(2).to_pylist() + b.column(3).to_pylist(), k)
                size = np.bincount(who, minlength=2 * n)
                pair = who % max(n, 1)
                order = np.lexsort((code, pair))
                p, c = pair[order], code[order]
                twice = (p[1:] == p[:-1]) & (c[1:] == c[:-1])
                shared = np.bincount(p[1:][twice], minlength=n)
                total = size[:n] + size[n:] - shared
                ok = shared * den >= total * num
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(shared[ok]), pa.array(total[ok])], ["a", "b", "shared", "total"])

    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, shared bigint, total bigint")


def similar_sequences(
    df: DataFrame, id_col: str, seq_col: str, k: int, num: int, den: int, size: int | None = None, common: int = 128, meet: int = 4, piece: int = 2048
) -> tuple[DataFrame, DataFrame]:
    """``pairs [a, b, shared, total]`` between sequences of different k-mer sets, a < b,
    whose sets of canonical k-mers have a Jaccard similarity of ``num/den`` or more; and
    ``members [id, rep]``, ``rep`` being the smallest id with the same k-mer set.

    Null ids, null sequences and sequences without a k-mer are in no pair and have no
    member row; an id given twice counts once; other columns are not read; an empty table
    gives no rows. A sketch keeps as many values as make the lists complete for the
    threshold, and the result is exact. ``size`` bounds the sketches of collections of long
    sequences; then a similar pair may be missed, the less the larger it is. ``meet`` values
    must be shared in the lists. ``common`` is the number of sketches above which a value
    goes to the end of the order, ``piece`` the length at which a list is cut for joining;
    these three change the work only.
    """
    keep = lambda n: retained(n, num, den, meet, size)
    members, sets = classes(_prepare(df, id_col, seq_col, k))
    texts = spread(sets.select("rep", "t"))
    first = _sketches(texts, k, keep, False)
    hot = cut(first.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > common))
    late = first.join(hot, "v").groupBy("rep").agg(F.collect_list("v").alias("hot"))
    inv = cut(_sketches(texts.join(late, "rep", "left"), k, keep, True))
    # a long list is cut into pieces on one side and repeated for each on the other
    long = inv.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > piece).select("v", F.ceil(F.col("c") / piece).cast("int").alias("k"))
    cutlists = inv.join(long, "v", "left")
    one = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"), F.lit(0)).alias("s")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k") - 1, F.lit(0)))).alias("s")
    ia = cutlists.select("v", one, F.col("rep").alias("a"), F.col("n").alias("na"))
    ib = cutlists.select("v", every, F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    met = ia.join(ib, ["v", "s"]).where((F.col("a") < F.col("b")) & fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest("na", "nb")).alias("m"))
    found = met.where(F.col("c") >= F.least(F.lit(meet), F.ceil(F.col("m") * num / den))).select("a", "b", "c")
    return cut(_verified(_likely(found, inv, num, den, size), sets, k, num, den)), members


def _likely(found: DataFrame, inv: DataFrame, num: int, den: int, size: int | None) -> DataFrame:
    """Pairs whose union sketch allows the threshold: up to the end of the shorter sketch
    all shared values are among the c seen, and no more than what the other set holds
    beyond its own sketch can follow; what they must share at least is known from n."""
    part = inv.groupBy("rep").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("p"))
    pa_, pb = part.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa")), part.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    most = F.col("c") + F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return found.join(pa_, "a").join(pb, "b").where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")
