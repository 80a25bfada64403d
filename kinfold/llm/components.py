"""Group ids over pairwise matches: connected components by seed-tree pruning.

Each round, every vertex and its neighbours are connected to the smallest id of that
neighbourhood. A vertex that nobody picked as a minimum can no longer be a seed: it drops
out of the graph and is hung below its smallest proposal in a propagation forest. The
graph shrinks geometrically; when no edge is left, the seed ids flow down the forest, one
join per round in reverse order. Rounds are checkpointed, so a lost executor costs one
round at most. A hub vertex is only ever aggregated with map-side combining or joined on
(where adaptive execution splits its partition); it is never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import mark


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``[group_id, record_id]``: every record occurring in a pair of two different
    records, with the smallest record id of its group.

    Null ids and pairs of a record with itself link nothing; repeated and reversed pairs
    count once. Columns other than ``a`` and ``b`` are not read. No pairs give no rows.
    """
    e = (
        pairs.select(F.col(a).cast("bigint").alias("s"), F.col(b).cast("bigint").alias("t"))
        .where("s is not null and t is not null and s <> t")
        .select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
        .distinct()
    )
    graph = mark(_both(e))
    forest: list[DataFrame] = []
    while not graph.isEmpty():
        if len(forest) >= max_rounds:
            raise RuntimeError(f"no convergence in {max_rounds} rounds")
        low = graph.groupBy("s").agg(F.min("t").alias("t")).select("s", F.least("s", "t").alias("m"))
        proposals = (
            graph.join(low, "s").select(F.col("t").alias("x"), F.col("m").alias("y")).unionByName(low.select(F.col("s").alias("x"), F.col("m").alias("y"))).distinct()
        )
        proposals = mark(proposals)
        best = proposals.groupBy("x").agg(F.min("y").alias("p"), F.max(F.col("x") == F.col("y")).alias("seed"))
        forest.append(mark(best.where(~F.col("seed")).select("x", "p")))
        kept = proposals.join(best.select("x", "p"), "x").where("y <> p").select(F.col("p").alias("s"), F.col("y").alias("t"))
        graph = mark(_both(kept.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()))
    if not forest:
        return e.select(F.col("s").alias("group_id"), F.col("t").alias("record_id")).limit(0)
    labels = forest[-1].select("x", F.col("p").alias("g"))
    for level in reversed(forest[:-1]):
        up = labels.select(F.col("x").alias("p"), "g")
        labels = mark(level.join(up, "p", "left").select("x", F.coalesce("g", "p").alias("g")).unionByName(labels))
    seeds = labels.select("g").distinct().select(F.col("g").alias("group_id"), F.col("g").alias("record_id"))
    return labels.select(F.col("g").alias("group_id"), F.col("x").alias("record_id")).unionByName(seeds)


def _both(e: DataFrame) -> DataFrame:
    """Each undirected edge in both directions, without a second pass over ``e``."""
    return e.select(F.explode(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))).alias("e")).select("e.s", "e.t")


def neighbour_links(knn: DataFrame, row_id: str = "row_id", indices: str = "indices", data: str = "data") -> DataFrame:
    """``[row_id, other]`` for each neighbour with a score above 0; null scores, the
    padding index -1 and the record itself link nothing. Lists of different lengths are
    matched by position, a missing score being null; null and empty lists give nothing."""
    zipped = F.explode(F.arrays_zip(F.col(indices).alias("i"), F.col(data).alias("d")))
    return (
        knn.select(F.col(row_id).alias("row_id"), zipped.alias("e"))
        .where("e.d > 0 and not isnan(e.d) and e.i <> -1 and e.i <> row_id")
        .select("row_id", F.col("e.i").alias("other"))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
