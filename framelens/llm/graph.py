"""Connected components by alternating large-star and small-star steps.

All links stay in DataFrames.  A first pass contracts the links of each partition to a spanning
forest; every step is written to the shared folder, so no lineage grows and lost executors only
repeat one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import stage, unstage

_BLOCK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest reachable node, for the nodes of the links (a, b)."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not ((up := root[root]) == root).all():
            root = up


def _forest(batches):
    held, size = [], 0

    def out():
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        node, root = local_roots(a, b)
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        size += batch.num_rows
        if size >= _BLOCK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs) that isn't its component's smallest."""
    now = stage(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        unstage(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        now = stage(small.select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct(), "small-star")
        unstage(large)
