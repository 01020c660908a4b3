"""View consistency: match confidences of neighbouring cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.schema import camera_pairs


def frame_scores(matches: DataFrame, reference_count: int = 50) -> DataFrame:
    """``matches`` (sample_id, cam_a, cam_b, t, mconf) with score = mean(mconf) * min(1, n / reference); no match gives 0, a null mconf (unread) null."""
    n = F.size("mconf")
    mean = F.aggregate("mconf", F.lit(0.0), lambda s, x: s + x) / n
    return matches.withColumn("score", F.when(F.col("mconf").isNull(), None).when(n == 0, 0.0).otherwise(mean * F.least(F.lit(1.0), n / F.lit(float(reference_count)))))


def pair_scores(frames: DataFrame) -> DataFrame:
    """sample_id, cam_a, cam_b, score, n_failed: unread frames are counted and not scored."""
    return frames.groupBy("sample_id", "cam_a", "cam_b").agg(F.avg("score").alias("score"), F.count_if(F.col("score").isNull()).alias("n_failed"))


def pair_videos(paths: DataFrame) -> DataFrame:
    """``paths`` (sample_id, view, path) joined to the pair table on both cameras."""
    pairs = camera_pairs(paths.sparkSession)
    one = paths.select("sample_id", F.col("view").alias("cam_a"), F.col("path").alias("path_a")).join(pairs, "cam_a")
    return one.join(paths.select("sample_id", F.col("view").alias("cam_b"), F.col("path").alias("path_b")), ["sample_id", "cam_b"])


def evaluate(samples: DataFrame, matches: DataFrame, reference_count: int = 50) -> DataFrame:
    """The mean of all six pairs; a sample of which any pair can't be scored is skipped."""
    pairs = camera_pairs(samples.sparkSession).select("cam_a", "cam_b")
    per = pair_scores(frame_scores(matches, reference_count)).join(pairs, ["cam_a", "cam_b"]).groupBy("sample_id").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    out = samples.select("sample_id").join(per, "sample_id", "left").withColumn("ok", F.coalesce(F.col("n") == 6, F.lit(False)))
    return out.select(F.lit("view_consistency").alias("metric"), "sample_id", F.when(F.col("ok"), F.col("mean")).alias("score"), F.when(F.col("ok"), "success").otherwise("skipped").alias("status"), F.when(~F.col("ok"), "some camera pair could not be scored").alias("reason"))
