"""Depth consistency: distances of neighbouring depth embeddings, and the rendering of depth clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.numeric import clamp01, finite
from framelens.operators.sequences import adjacent_distance


def clip_scores(embeddings: DataFrame, scale: float = 1.0) -> DataFrame:
    """sample_id, view, l2, score = exp(-scale * l2); null below two frames."""
    out = adjacent_distance(embeddings, ["sample_id", "view"], ["t"], "feature")
    return out.withColumn("score", clamp01(F.exp(-scale * F.col("l2"))))


def rendered(pixels: DataFrame, keys=("sample_id", "view")) -> DataFrame:
    """``pixels`` (keys, t, y, x, depth) with gray: 0..255 by the smallest and largest depth of the whole clip.

    What isn't finite counts as 0; a flat clip is 0 everywhere.
    """
    depth = F.when(finite(F.col("depth")), F.col("depth")).otherwise(0.0)
    pixels = pixels.withColumn("_d", depth)
    # an aggregation and a join, so that no task holds a whole clip
    out = pixels.join(pixels.groupBy(*keys).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")), list(keys))
    gray = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255)).otherwise(0)
    return out.withColumn("gray", gray.cast("int")).drop("_d", "_lo", "_hi")


def map_else_video(maps: DataFrame, videos: DataFrame) -> DataFrame:
    """A view's score from its prepared depth map, else from its video, with the source of it."""
    joined = maps.select("sample_id", "view", F.col("score").alias("m")).join(videos.select("sample_id", "view", F.col("score").alias("v")), ["sample_id", "view"], "full_outer")
    return joined.select("sample_id", "view", F.coalesce("m", "v").alias("score"), F.when(F.col("m").isNotNull(), "depth_map").when(F.col("v").isNotNull(), "video").alias("source"))


def evaluate(samples: DataFrame, view_scores: DataFrame) -> DataFrame:
    per = view_scores.groupBy("sample_id").agg(F.avg("score").alias("score"))
    out = samples.select("sample_id").join(per, "sample_id", "left")
    return out.select(F.lit("depth_consistency").alias("metric"), "sample_id", "score", F.when(F.col("score").isNotNull(), "success").otherwise("skipped").alias("status"), F.when(F.col("score").isNull(), "no view could be scored").alias("reason"))
