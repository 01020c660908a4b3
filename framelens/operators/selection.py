"""Tag indexes: summaries, dedup, view resolution and seeded selection of valid samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions.text import sample_id, view_of
from framelens.schema import TRACKS, VIEWS


def tag_summary(index: DataFrame) -> DataFrame:
    """``index`` (tag, items) to (tag, sample_count), null counts last, then by count descending and tag."""
    out = index.select("tag", F.when(F.col("items").isNotNull(), F.size("items").cast("long")).alias("sample_count"))
    return out.orderBy(F.col("sample_count").isNull(), F.desc("sample_count"), "tag")


def unique_videos(items: DataFrame) -> DataFrame:
    """``items`` (position, tag, video) to (video, first_position, tags): one row a trimmed video, tags by first sight."""
    rows = items.withColumn("video", F.trim(F.col("video").cast("string"))).where("video <> ''")
    firsts = rows.groupBy("video", "tag").agg(F.min("position").alias("position"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("position", "tag"))), lambda x: x["tag"])
    return firsts.groupBy("video").agg(F.min("position").alias("first_position"), seen.alias("tags"))


def dedup_stats(items: DataFrame) -> DataFrame:
    """Totals by (video, hdmap); an item with neither counts as a duplicate."""
    key = F.when(F.col("video").isNotNull() | F.col("hdmap").isNotNull(), F.struct("video", "hdmap"))
    keyed = items.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    out = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"), F.count("k").alias("unique_samples"))
    dup = F.greatest(F.col("total_items") - F.col("unique_samples"), F.lit(0))
    return out.select("*", dup.alias("duplicate_items"), F.when(F.col("total_items") > 0, dup / F.col("total_items")).otherwise(0.0).alias("duplicate_ratio"))


def resolved_views(files: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """``files`` (video, path) to (video, camera_videos, reason).

    The reason names the view that is first met twice when files are read in the order of their paths,
    part by part, else the views that are missing.  ``videos`` (video) adds those without any file.
    """
    parts = F.struct(F.split("path", "/").alias("parts"), "path")
    seen = files.withColumn("view", view_of(F.col("path"))).groupBy("video", "view").agg(F.slice(F.array_sort(F.collect_list(parts)), 1, 2).alias("two"))
    seen = seen.select("video", "view", F.try_element_at("two", F.lit(1))["path"].alias("path"), F.try_element_at("two", F.lit(2))["parts"].alias("again"))
    rank = F.array_position(F.array(*[F.lit(v) for v in VIEWS]), F.col("view"))
    per = seen.groupBy("video").agg(F.array_sort(F.collect_list(F.when(F.col("view").isNotNull(), F.struct(rank.alias("r"), "view", "path", "again")))).alias("v"))
    twice = F.array_sort(F.transform(F.filter("v", lambda x: x["again"].isNotNull()), lambda x: F.struct(x["again"].alias("again"), x["view"].alias("view"))))
    missing = F.array_except(F.array(*[F.lit(v) for v in VIEWS]), F.transform("v", lambda x: x["view"]))
    reason = F.when(F.size(twice) > 0, F.concat(F.lit("multiple files matched view '"), F.try_element_at(twice, F.lit(1))["view"], F.lit("': "), F.col("video"))).when(F.size(missing) > 0, F.concat(F.lit("missing expected views: "), F.array_join(missing, ", ")))
    cams = F.map_from_entries(F.transform("v", lambda x: F.struct(x["view"], x["path"])))
    out = per.select("video", F.when(reason.isNull(), cams).alias("camera_videos"), reason.alias("reason"))
    if videos is None:
        return out
    out = videos.select("video").distinct().join(out.withColumn("listed", F.lit(True)), "video", "left")
    return out.select("video", "camera_videos", F.when(F.col("listed"), F.col("reason")).otherwise(F.concat(F.lit("video path cannot be expanded: "), "video")).alias("reason"))


def selected(candidates: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``candidates`` (video, reason) in seeded order with rank, scanned and selected.

    Rows are scanned until ``size`` valid ones are selected. The order is that of a seeded hash, then
    the video, so it is the same on every run; it is not that of a Mersenne Twister shuffle. A valid
    row's place needs a running count, which is kept distributed: hash buckets are counted first.
    """
    rows = candidates.withColumn("draw", F.xxhash64(F.lit(seed), "video")).withColumn("bucket", F.shiftright("draw", 52))
    order = Window.partitionBy("bucket").orderBy("draw", "video")
    valid = F.col("reason").isNull().cast("long")
    counts = rows.groupBy("bucket").agg(F.sum(valid).alias("v"), F.count("*").alias("n"))  # 4096 rows at most
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bucket", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum(valid).over(prior), F.lit(0))).withColumn("place", F.row_number().over(order)).join(counts, "bucket")
    scanned = (F.col("ahead") + F.col("v0")) < size
    return rows.select(*candidates.columns, (F.col("place") + F.col("n0")).alias("rank"), scanned.alias("scanned"), (scanned & F.col("reason").isNull()).alias("selected"))


def invalid_reasons(scan: DataFrame) -> DataFrame:
    return scan.where("scanned AND reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def payload(chosen: DataFrame, dataset: str) -> DataFrame:
    """Sample rows of selected videos (video, tags, camera_videos)."""
    meta = F.struct(F.col("video").alias("source_video_dir"), "camera_videos", "tags")
    none = F.array().cast(f"array<struct<{TRACKS}>>")
    return chosen.select(sample_id(F.lit(dataset), F.col("video")).alias("sample_id"), F.col("camera_videos")["camera_front"].alias("generated_video"), F.lit(None).cast("string").alias("reference_video"), F.lit("").alias("prompt"), none.alias("objects"), meta.alias("metadata"))
