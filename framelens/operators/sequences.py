"""Statistics of ordered vectors: adjacent cosine, jitter, and nested means.

All terms of a sequence come from one window specification, so Spark plans one sort and window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.numeric import clamp01, dot, finite, minus, norm, unit

EPS = 1e-8


def sequence_scores(features: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str, normalize: bool = True, strict: bool = True, eps: float = EPS) -> DataFrame:
    """keys, n_frames, acm, tji, score of every sequence.

    acm: mean adjacent cosine, clipped to [0, 1].  tji: mean of |second difference| over the mean of
    both velocities, 0 below three frames.  score: acm / (1 + tji), null below two frames.  With any
    value that is not finite all three are null, or 0 unless ``strict``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = features.withColumn("_ok", F.coalesce(F.forall(F.col(vector), finite), F.lit(False)))
    rows = rows.withColumn("_u", unit(F.col(vector), eps) if normalize else F.col(vector))
    rows = rows.select(*keys, *[c for c in order if c not in keys], "_ok", "_u", F.lag("_u", 1).over(w).alias("_p"), F.lag("_u", 2).over(w).alias("_q"))
    second = F.zip_with(minus(F.col("_u"), F.col("_p")), minus(F.col("_p"), F.col("_q")), lambda a, b: a - b)
    rows = rows.select(*keys, *[c for c in order if c not in keys], "_ok", clamp01(dot(F.col("_u"), F.col("_p"))).alias("_cos"), norm(minus(F.col("_u"), F.col("_p"))).alias("_vel"), F.when(F.col("_q").isNotNull(), norm(second)).alias("_acc"))
    rows = rows.withColumn("_jit", F.col("_acc") / (0.5 * (F.col("_vel") + F.lag("_vel").over(w)) + eps))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.bool_and("_ok").alias("_ok"), F.avg("_cos").alias("acm"), F.coalesce(F.avg("_jit"), F.lit(0.0)).alias("tji"))
    found = {"acm": F.col("acm"), "tji": F.col("tji"), "score": clamp01(F.col("acm") / (1 + F.col("tji")))}
    held = lambda c: F.when(F.col("n_frames") >= 2, F.when(F.col("_ok"), c).otherwise(None if strict else 0.0))
    return out.select(*keys, "n_frames", *(held(c).alias(name) for name, c in found.items()))


def nested_mean(scores: DataFrame, levels: Sequence[str], value: str = "score") -> DataFrame:
    """Unweighted means, level by level: the last level is averaged away first. Nulls don't count."""
    out = scores
    for i in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:i]).agg(F.avg(value).alias(value))
    return out


def adjacent_distance(features: DataFrame, keys: Sequence[str], order: Sequence[str], vector: str) -> DataFrame:
    """keys, l2: mean Euclidean distance of neighbours, not normalised."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = features.select(*keys, vector, F.lag(vector).over(w).alias("_p"))
    return rows.groupBy(*keys).agg(F.avg(norm(minus(F.col(vector), F.col("_p")))).alias("l2"))


def strided(frames: DataFrame, keys: Sequence[str], index: str, stride: int = 1, most: int | None = None) -> DataFrame:
    """Every ``stride``-th frame of each sequence, at most ``most`` of them."""
    out = frames.where(F.col(index) % stride == 0)
    return out if most is None else out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(index))).where(F.col("_n") <= most).drop("_n")
