"""Overlap sizes of many large sets by incremental pair counts.

The state holds the memberships and, for each pair of sets that share an item, how many
they share. When identifiers join or leave sets, only these changes are joined against the
memberships of the same identifiers, and the signed pair deltas are added to the counts.

The state is a folder of tables to which every change set appends one generation:
memberships with their signs in buckets by item, pair deltas, and items that became common.
A change set reads the buckets of its items only and writes what it changes, so its cost
follows the change. Generations are merged when there are several, and the list of valid
ones is written last, so that a state that was cut off goes on from its last change set.

Items in over ``most`` sets would give quadratically many deltas; they are kept as
memberships only, and their share in a pair is counted on demand for the pairs that can
still qualify. An item that becomes that common leaves the pair counts by signed deltas.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import children, cut, ensure_checkpoint_dir, prepare, read_small, remove, write_small
from .components import union_all

MEMBERS, COMMON, PAIRS = "row bigint, item bigint, sign int", "item bigint", "a bigint, b bigint, n bigint"


@dataclass(frozen=True)
class PairCounts:
    """A state in ``folder``: ``members [row, item]`` (distinct), ``common [item]``, and
    ``pairs [a, b, n]`` with a < b and the number n of shared items that are not common."""

    spark: SparkSession
    folder: str
    most: int
    buckets: int
    live: tuple[str, ...] = ()
    commons: tuple[str, ...] = ()
    step: int = 0

    @staticmethod
    def open(spark: SparkSession, folder: str, most: int = 512, buckets: int = 8) -> PairCounts:
        """The last state stored in ``folder``, or an empty one. ``most`` is the number of
        sets above which an item counts as common; it changes the work, not the overlaps.
        A stored state keeps the ``most`` and ``buckets`` it was begun with."""
        prepare(spark)
        heads = sorted(x for x in children(spark, f"{folder}/heads") if not x.startswith("."))
        if not heads:
            return PairCounts(spark, folder, most, buckets)
        h = json.loads(read_small(spark, f"{folder}/heads/{heads[-1]}"))
        return PairCounts(spark, folder, h["most"], h["buckets"], tuple(h["live"]), tuple(h["commons"]), h["step"])

    def _read(self, what: str, schema: str, gens: tuple[str, ...]) -> DataFrame:
        """The rows of the given generations of a table."""
        if not gens:
            return self.spark.range(0).select(*[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")])
        paths = [f"{self.folder}/{what}/gen={g}" for g in gens]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}").parquet(*paths)

    def _log(self, gens: tuple[str, ...] | None = None) -> DataFrame:
        return self._read("members", MEMBERS + ", b int", self.live if gens is None else gens)

    @property
    def members(self) -> DataFrame:
        return _held(self._log())

    @property
    def common(self) -> DataFrame:
        return self._read("common", COMMON, self.commons).select("item")

    @property
    def pairs(self) -> DataFrame:
        return _summed(self._read("pairs", PAIRS, self.live))

    def _store(self, members: DataFrame, gen: Column) -> None:
        rows = members.select("row", "item", "sign", gen.alias("gen"), F.pmod(F.xxhash64("item"), F.lit(self.buckets)).cast("int").alias("b"))
        rows.repartition("gen", "b").sortWithinPartitions("gen", "b", "item").write.mode("append").partitionBy("gen", "b").parquet(f"{self.folder}/members")

    def _committed(self, live: tuple[str, ...], commons: tuple[str, ...]) -> PairCounts:
        after = replace(self, live=live, commons=commons, step=self.step + 1)
        head = {"live": live, "commons": commons, "most": self.most, "buckets": self.buckets, "step": after.step}
        write_small(self.spark, f"{self.folder}/heads/{after.step:08d}", json.dumps(head))
        return after

    def apply(self, changes: DataFrame, merge_at: int = 12) -> PairCounts:
        """The state after ``changes [row, item, sign]``: 1 joins, -1 leaves; at most one
        change per membership, leaves only of what is there, joins only of what is not.
        ``merge_at``: the number of generations that are merged into one."""
        gen = uuid.uuid4().hex
        self._store(changes, F.lit(gen))
        return self.advance(gen, merge_at)

    def stage(self, changes: DataFrame, batch: str) -> list[str]:
        """Store many change sets at once, by the column ``batch``; returns their generations
        in order, each still to be given to ``advance``."""
        batches = [r[0] for r in changes.select(batch).distinct().orderBy(batch).collect()]  # a row per batch
        run = uuid.uuid4().hex
        self._store(changes, F.concat(F.lit(f"{run}-"), F.col(batch).cast("string")))
        return [f"{run}-{x}" for x in batches]

    def advance(self, gen: str, merge_at: int = 12) -> PairCounts:
        """The state after the stored changes of one generation."""
        changes = self._log((gen,)).select("row", "item", "sign")
        sizes = changes.select("item", "sign")
        if self.live:
            touched = [int(x[2:]) for x in children(self.spark, f"{self.folder}/members/gen={gen}") if x.startswith("b=")]
            before = _held(self._log().where(F.col("b").isin(touched)).join(changes.select("item").distinct(), "item", "left_semi"))
            sizes = sizes.unionByName(before.select("item", F.lit(1).alias("sign")))
        else:
            before = self.members
        sizes = sizes.groupBy("item").agg(F.sum("sign").alias("c"))
        commons, light, near = self.commons, changes, before
        if commons:
            light, near = light.join(self.common, "item", "left_anti"), before.join(self.common, "item", "left_anti")
        if (sizes.agg(F.max("c")).first()[0] or 0) > self.most:
            became = sizes.where(F.col("c") > self.most).select("item")
            (became.join(self.common, "item", "left_anti") if commons else became).write.parquet(f"{self.folder}/common/gen={gen}")
            commons = (*commons, gen)
            became = self._read("common", COMMON, (gen,)).select("item")
            gone = near.join(became, "item").select("row", "item", F.lit(-1).alias("sign"))
            light = light.join(became, "item", "left_anti").unionByName(gone)
        _summed(_deltas(light, near if self.live else None)).write.parquet(f"{self.folder}/pairs/gen={gen}")
        after = self._committed((*self.live, gen), commons)
        return after._merged() if len(after.live) >= merge_at else after

    def _merged(self) -> PairCounts:
        gen = uuid.uuid4().hex
        self._store(self._log().groupBy("row", "item").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"), F.lit(gen))
        self.pairs.write.parquet(f"{self.folder}/pairs/gen={gen}")
        after = self._committed((gen,), self.commons)
        for old in self.live:
            for what in ("members", "pairs"):
                remove(self.spark, f"{self.folder}/{what}/gen={old}")
        return after


def _held(log: DataFrame) -> DataFrame:
    return log.groupBy("row", "item").agg(F.sum("sign").alias("n")).where("n > 0").select("row", "item")


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def _deltas(changes: DataFrame, before: DataFrame | None) -> DataFrame:
    """Signed pair counts: each change against the memberships before, and against the
    other changes of its item (two joins add a pair, two leaves take one back twice
    counted, a join and a leave cancel)."""
    c = changes.select("item", F.col("row").alias("x"), F.col("sign").alias("sx"))
    other = changes.select("item", F.col("row").alias("y"), F.col("sign").alias("sy"))
    if before is not None:
        other = other.unionByName(before.select("item", F.col("row").alias("y"), F.lit(0).alias("sy")))
    met = c.join(other, "item").where("x <> y and (sy = 0 or x < y)")
    n = F.when(F.col("sy") == 0, F.col("sx")).otherwise(F.col("sx") * F.col("sy"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), n.cast("bigint").alias("n"))


def overlapping_sets(state: PairCounts, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """``[a, b, shared, na, nb]``: pairs of sets that share at least ``num/den`` of the
    items of the smaller one, a < b; ``sizes [row, n]``. Exact, common items included."""
    enough = F.least("na", "nb") * num
    na, nb = sizes.select(F.col("row").alias("a"), F.col("n").alias("na")), sizes.select(F.col("row").alias("b"), F.col("n").alias("nb"))
    if not state.commons:
        rated = state.pairs.join(na, "a").join(nb, "b").where(F.col("n") * den >= enough)
        return rated.select("a", "b", F.col("n").alias("shared"), "na", "nb")
    big = cut(state.members.join(state.common, "item"))
    freq = big.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    info = cut(sizes.join(big.groupBy("row").agg(F.count(F.lit(1)).alias("h")), "row", "left").select("row", "n", F.coalesce("h", F.lit(0)).alias("h")))
    ia = info.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    ib = info.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    # sets that could qualify by common items alone: look up a prefix of those, rarest first
    need = F.ceil(F.col("n") * num / den)
    mostly = info.where(F.col("h") >= need).select("row", "n", (F.col("h") - need + 1).alias("p"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("c", "item"))
    prefix = mostly.join(big, "row").join(freq, "item").withColumn("r", place).where("r <= p").select(F.col("row").alias("x"), F.col("n").alias("nx"), "item")
    larger = big.join(info.select("row", F.col("n").alias("ny")), "row").select(F.col("row").alias("y"), "ny", "item")
    # a hot item's list is cut into salted pieces, and its probes go to every piece
    salts = freq.select("item", F.ceil(F.col("c") / 4096).cast("int").alias("k"))
    probes = prefix.join(salts, "item").select("x", "nx", "item", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    listed = larger.join(salts, "item").select("y", "ny", "item", F.pmod(F.xxhash64("y"), F.col("k")).cast("int").alias("salt"))
    extra = probes.join(listed, ["item", "salt"]).where("x <> y and ny >= nx").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rated = _sum_or_zero(state.pairs, extra)
    likely = cut(rated.join(ia, "a").join(ib, "b").where((F.col("n") + F.least("ha", "hb")) * den >= enough))
    ha, hb = big.select(F.col("row").alias("a"), "item"), big.select(F.col("row").alias("b"), "item")
    open_ = likely.where("ha > 0 and hb > 0").select("a", "b")
    # the shorter list of common items is spelled out, then looked up in the other set
    seen = open_.join(ha, "a").join(hb, ["b", "item"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    total = F.col("n") + F.coalesce("c", F.lit(0))
    return likely.join(seen, ["a", "b"], "left").select("a", "b", total.alias("shared"), "na", "nb").where(F.col("shared") * den >= F.least("na", "nb") * num)


def _sum_or_zero(pairs: DataFrame, extra: DataFrame) -> DataFrame:
    return union_all([pairs.select("a", "b", "n"), extra.select("a", "b", F.lit(0).cast("bigint").alias("n"))]).groupBy("a", "b").agg(F.sum("n").alias("n"))


def set_overlaps(df: DataFrame, row: str, item: str, weight: str | None, batch: str | None, num: int, den: int, most: int = 512, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs [a, b, shared, na, nb]`` between different sets, and ``members [id, rep]``.

    A set holds its distinct items; a null weight stands for 1, and an item with weight 0
    in all of its rows is not in the set. Rows with a null row or item id belong to none;
    other columns are not read; an empty table gives no rows. Equal sets are one
    (``rep`` is their smallest id). With ``batch``, the batches are applied to the counts as
    changes, one after the other (null first). The counts are kept in the folder ``store``,
    which must be new; without one they are removed in the end.
    """
    spark = df.sparkSession
    live = F.lit(True) if weight is None else F.coalesce(F.col(weight), F.lit(1.0)) != 0
    when = F.lit(0) if batch is None else F.coalesce(F.col(batch), F.lit(-(2**31)))
    rows = df.where(F.col(row).isNotNull() & F.col(item).isNotNull() & live).select(F.col(row).cast("bigint").alias("row"), F.col(item).cast("bigint").alias("item"), when.alias("w"))
    held = cut(rows.groupBy("row", "item").agg(F.min("w").alias("w")))
    # equal sets by size and two independent sums of item hashes, 128 bits in all
    print_ = held.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("f"), F.bit_xor(F.xxhash64("item", F.lit("second"))).alias("g")
    )
    print_ = cut(print_)
    reps = print_.groupBy("n", "f", "g").agg(F.min("row").alias("rep"))
    members = cut(print_.join(reps, ["n", "f", "g"]).select(F.col("row").alias("id"), "rep", "n"))
    sizes = members.where("id = rep").select(F.col("rep").alias("row"), "n")
    kept = cut(held.join(sizes.select("row"), "row").select("row", "item", "w", F.lit(1).alias("sign")))
    folder = store or f"{ensure_checkpoint_dir(spark)}/overlaps-{uuid.uuid4().hex}"
    state = PairCounts.open(spark, folder, most)
    for gen in state.stage(kept, "w"):
        state = state.advance(gen)
    pairs = cut(overlapping_sets(state, sizes, num, den))
    if store is None:
        remove(spark, folder)
    return pairs, members.select("id", "rep")
