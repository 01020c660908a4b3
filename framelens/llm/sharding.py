"""Sharding by minimax contiguous partition.

The atomic groups are the documents of equal text, ordered by a 64-bit hash of the text.  The driver
looks for the smallest shard capacity by binary search, checks each greedily and cuts there.  It holds
the order as a radix tree of sums: one histogram of ``FANOUT`` bins over the top bits, and finer ones
only of bins that a cut falls into, each from one job over the staged table of group sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import stage, text_or_empty, unstage

DIGIT_BITS = 12
FANOUT = 1 << DIGIT_BITS
#: 12-bit digits of the 60-bit group key.
LEVELS = 5


@dataclass
class _Node:
    """Sums over the children of one bin, or over the whole order."""

    level: int
    digits: np.ndarray
    sizes: np.ndarray
    groups: np.ndarray
    starts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


class _Order:
    """The group sizes in key order, refined where they are asked for."""

    def __init__(self, groups: DataFrame):
        self.table, self.nodes = groups, {}
        self.nodes[()] = self._fetch([()])[()]
        self.total = int(self.nodes[()].starts[-1])
        self.jobs = 1

    def _fetch(self, paths: list[tuple[int, ...]]) -> dict[tuple[int, ...], _Node]:
        level = len(paths[0])
        shift = DIGIT_BITS * (LEVELS - level)
        prefix = F.shiftright("key", shift) if level else F.lit(0).cast("long")
        code = {sum(d << DIGIT_BITS * (level - 1 - i) for i, d in enumerate(p)): p for p in paths}
        rows = self.table
        if level:  # as ranges of the key, which Parquet's statistics of the sorted table can prune by
            rows = rows.where(reduce(or_, (F.col("key").between(c << shift, ((c + 1) << shift) - 1) for c in code)))
        bins = rows.groupBy(prefix.alias("prefix"), (F.shiftright("key", shift - DIGIT_BITS) % FANOUT).alias("digit")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found: dict[tuple[int, ...], list] = {p: [] for p in paths}
        for r in bins.collect():  # FANOUT rows a path at most
            found[code[r.prefix]].append((r.digit, r.bytes, r.n))
        return {p: _Node(level, *(np.array(x, np.int64) for x in (zip(*sorted(v)) if v else ([], [], [])))) for p, v in found.items()}

    def end(self, start: int, cap: int, near: int = 1) -> tuple[int, tuple[int, ...] | None]:
        """The sum before the first group that a shard from ``start`` can't take, and its key's digits."""
        limit, base, path = start + cap, 0, ()
        if limit >= self.total:
            return self.total, None
        while True:
            node = self.nodes[path]
            i = int(np.searchsorted(node.starts, limit - base, "right")) - 1
            base += int(node.starts[i])
            digit = int(node.digits[i])
            if node.level == LEVELS - 1 or node.groups[i] == 1:
                return base, (*path, digit)
            if (*path, digit) not in self.nodes:
                own = [(*path, int(node.digits[j])) for j in range(max(0, i - near), min(len(node.digits), i + near + 1)) if node.groups[j] > 1]
                self.nodes |= self._fetch([p for p in own if p not in self.nodes])
                self.jobs += 1
            path = (*path, digit)

    def prepare(self, positions: list[int], near: int = 1) -> None:
        """Refines the order around all ``positions``, one job a level for all of them."""
        states = [(p, 0, ()) for p in positions if 0 <= p < self.total]
        while states:
            want, deeper = set(), []
            for at, base, path in states:
                node = self.nodes[path]
                i = int(np.searchsorted(node.starts, at - base, "right")) - 1
                if node.level < LEVELS - 1:
                    own = [j for j in range(max(0, i - near), min(len(node.digits), i + near + 1)) if node.groups[j] > 1]
                    want.update((*path, int(node.digits[j])) for j in own)
                    if i in own:
                        deeper.append((at, base + int(node.starts[i]), (*path, int(node.digits[i]))))
            if want := sorted(want - set(self.nodes)):
                self.nodes |= self._fetch(want)
                self.jobs += 1
            states = deeper

    def cuts(self, cap: int, shards: int) -> list[tuple[int, ...]] | None:
        """Where each next shard begins, or None if the capacity is too small."""
        self.prepare([cap * k for k in range(1, shards)])
        at, found = 0, []
        for _ in range(shards):
            to, key = self.end(at, cap)
            if key is None:
                return found
            if to == at:
                return None
            found.append(key)
            at = to
        return None


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first key of each shard but the first. ``groups``: key (60 bits), bytes."""
    order = _Order(groups)
    if not order.total:
        return 0, []
    low = max(-(-order.total // shards), int(groups.agg(F.max("bytes")).first()[0]))
    high = low
    while (best := order.cuts(high, shards)) is None:
        low, high = high + 1, high + max(1, (high - low + 1) * 4, order.total >> 14)
    while low < high:
        middle = (low + high) // 2
        found = order.cuts(middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return high, [sum(d << DIGIT_BITS * (LEVELS - 1 - i) for i, d in enumerate(k)) for k in best]


def group_key(text):
    return F.shiftrightunsigned(F.xxhash64(text, F.crc32(text.cast("binary"))), 64 - DIGIT_BITS * LEVELS)


def shard(docs: DataFrame, shards: int = 16, rows_per_bucket: int = 10_000, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, text_key of every row of ``docs``; with ``whole`` also ``row``, all its columns.

    A row's size is its text's UTF-8 bytes plus one; a null text is empty.  Equal texts share a shard,
    and the largest shard is as small as cuts in key order allow.  Slots are gapless from 0 in each
    shard, over buckets of hashed doc_ids, so that no shard and no group of copies is sorted in one
    task.  Repeated rows get a slot each; an empty table gives no row; other columns are not read.
    """
    text = text_or_empty()
    columns = ["doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(text).alias("text_key")]
    rows = stage(docs.select(*columns), "sizes")
    groups = stage(rows.groupBy(F.col("text_key").alias("key")).agg(F.sum("size").alias("bytes")).sort("key"), "groups")
    _, cuts = minimax_cuts(groups, shards)
    unstage(groups)
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col("text_key") >= c, 1).otherwise(0)
    buckets = max(1, min(1 << 16, -(-rows.count() // rows_per_bucket)))
    if whole:
        rows = docs.select(*columns, F.struct(*docs.columns).alias("row"))
    return numbered(rows.withColumn("shard", number.cast("int")), "shard", ["doc_id", "text_key", "size"], buckets)


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of ``docs`` with their shard and slot, which replace columns of these names."""
    out = shard(docs, shards, whole=True)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


def numbered(rows: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """Adds ``slot``, from 0 in each ``key``; the order is that of hashed buckets, then of ``order``."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ahead = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select(F.col(key).alias("of"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1
    out = rows.withColumn("within", within).join(ahead, F.col(key).eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    return out.withColumn("slot", (F.col("within") + F.col("ahead")).cast("long")).drop("within", "of", "of_bucket", "ahead", "bucket")
