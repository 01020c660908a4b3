"""Shards of ordered rows: round robin and contiguous, their union in order, and bounded examples.

Ranks come from counts of at most ``RANGES`` ranges of the key, and a window within each range, so that
no task sorts the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1 << 14


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with rank, from 0, by the integer ``key``; equal keys in any order, null keys last."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = (hi - lo) // RANGES + 1
    part = F.coalesce(F.floor((F.col(key) - lo) / width).cast("int"), F.lit(RANGES + 1))
    keyed = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return keyed.withColumn("_own", own).join(F.broadcast(ahead), "_part").withColumn("rank", F.col("_ahead") + F.col("_own")).drop("_part", "_ahead", "_own")


def round_robin(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with rank and shard = rank modulo ``n``."""
    return ranked(rows, key).withColumn("shard", F.col("rank") % n)


def contiguous(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with rank, shard and place: shards of ``size`` rows in order, the last may be smaller."""
    return ranked(rows, key).withColumn("shard", F.expr(f"rank div {int(size)}")).withColumn("place", F.col("rank") % size)


def in_order(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """The union of shards' rows, ordered."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def examples(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """keys, examples: the first ``most`` rows of each group, as structs in order; none for a limit of 0 or less."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    others = [c for c in rows.columns if c not in keys]
    first = rows.withColumn("_n", n).where(F.col("_n") <= max(0, most))
    held = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*others).alias("row")))), lambda x: x["row"])
    return first.groupBy(*keys).agg(held.alias("examples"))
