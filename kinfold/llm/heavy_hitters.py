"""Most frequent values of a huge column by exact, spillable aggregation.

Plan: one hash aggregation per observation id removes redelivered rows, a second one
with map-side combining sums the counts per value (a hot value reaches the shuffle as one
partial sum per map task), each partition keeps its local top k and one ordered limit
merges them. Both aggregations spill to disk; no task holds more than its hash partition
and the driver sees k rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_totals(df: DataFrame, value: str, count: str, obs_id: str | None = None) -> DataFrame:
    """``[value, total]`` with the exact total count of every value.

    Rows with a null value or a null count are left out. With ``obs_id``, rows of one
    observation count once; a row whose observation id is null cannot be recognised as a
    repeat and counts by itself. Only the named columns are read, so further columns, of
    whatever names, play no part. An empty table gives no rows.
    """
    cols = [F.col(value).alias("v"), F.col(count).cast("bigint").alias("c")]
    rows = df.where(F.col(value).isNotNull() & F.col(count).isNotNull())
    if obs_id is None:
        rows = rows.select(*cols)
    else:
        rows = (
            rows.select(*cols, F.col(obs_id).alias("o"), F.when(F.col(obs_id).isNull(), F.monotonically_increasing_id()).alias("own"))
            .groupBy("o", "own")
            .agg(F.first("v").alias("v"), F.first("c").alias("c"))
        )
    return rows.groupBy("v").agg(F.sum("c").alias("total")).select(F.col("v").alias(value), "total")


def top_values(df: DataFrame, value: str, count: str, k: int, obs_id: str | None = None) -> DataFrame:
    """The ``k`` values with the largest totals, ``[value, total, rk]``; ties at the last
    place go to the smaller value. Fewer than ``k`` distinct values give fewer rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    top = value_totals(df, value, count, obs_id).orderBy(F.desc("total"), F.asc(value)).limit(k)
    from pyspark.sql import Window

    return top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("total"), F.asc(value))))


def frequent_values(df: DataFrame, value: str, count: str, share_num: int, share_den: int, obs_id: str | None = None) -> DataFrame:
    """``[value, total]`` of the values whose total is at least ``share_num/share_den`` of all.

    At most ``share_den // share_num`` values can qualify, which is the k of the local and
    final top k (so the bound drops nothing). The comparison is in integers. The grand
    total is a scalar subquery over the same aggregation; its shuffle is reused. A count
    below 0 would break the bound and fails the query.
    """
    if share_num < 1 or share_den < share_num:
        raise ValueError("the share must lie in (0, 1]")
    negative = F.raise_error(F.concat(F.lit("negative count: "), F.col(count).cast("string"))).cast("bigint")
    checked = df.select(F.col(value), F.when(F.col(count) < 0, negative).otherwise(F.col(count)).alias(count), *([obs_id] if obs_id else []))
    totals = value_totals(checked, value, count, obs_id)
    grand = totals.agg(F.sum("total")).scalar()
    top = totals.orderBy(F.desc("total"), F.asc(value)).limit(share_den // share_num)
    return top.where((F.col("total").cast("decimal(38,0)") * share_den >= grand.cast("decimal(38,0)") * share_num) & (F.col("total") > 0))
