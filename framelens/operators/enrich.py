"""Reference preparation: merging what generators add to a sample's metadata, and its accounting."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROTECTED = "camera_videos"


def merge_metadata(left, right):
    """Maps of strings; the right side wins, and must not hold the protected key."""
    guarded = F.when(F.map_contains_key(right, PROTECTED), F.raise_error(F.lit(f"metadata['{PROTECTED}'] is protected"))).otherwise(right)
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(guarded, k))
    return F.map_concat(kept, guarded)


def enriched(samples: DataFrame, patches: DataFrame) -> DataFrame:
    """``samples`` (sample_id, metadata) with the patches (sample_id, generator, rank, patch, error) folded in.

    Patches apply by rank; a failed or missing one leaves the metadata as it is.
    """
    good = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("rank", F.map_entries("patch").alias("patch")))))
    per = patches.groupBy("sample_id").agg(good.alias("g"))
    out = samples.join(per, "sample_id", "left")
    entries = F.flatten(F.transform(F.coalesce("g", F.array().cast("array<struct<rank:int,patch:array<struct<key:string,value:string>>>>")), lambda x: x["patch"]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    folded = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return out.withColumn("metadata", merge_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")), folded)).drop("g")


def merged_json(metadata: str | None, patches: list[dict]) -> str:
    """Metadata with patches folded in: a value that is JSON is that, any other text; an object joins an object."""
    merged = json.loads(metadata) if metadata else {}
    for patch in patches:
        for key, text in patch.items():
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                value = text
            merged[key] = {**merged[key], **value} if isinstance(value, dict) and isinstance(merged.get(key), dict) else value
    return json.dumps(merged, ensure_ascii=False)


def guarded(patches: DataFrame) -> DataFrame:
    """Patches of which those with a protected key are errors of their generator."""
    bad = F.col("error").isNull() & F.coalesce(F.map_contains_key("patch", PROTECTED), F.lit(False))
    return patches.withColumn("error", F.when(bad, f"ValueError: Reference generators must not overwrite protected metadata key: {PROTECTED}").otherwise(F.col("error")))


def enriched_metadata(samples: DataFrame, patches: DataFrame) -> DataFrame:
    """``samples`` with their VARIANT ``metadata`` enriched: good patches apply by rank, objects join key by key."""
    good = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("rank", F.to_json("patch").alias("patch")))))
    per = patches.groupBy("sample_id").agg(F.transform(good, lambda x: x["patch"]).alias("_patches"))

    def fold(metadata: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([merged_json(m, [json.loads(x) for x in p]) for m, p in zip(metadata, found)])

    out = samples.join(per, "sample_id", "left")
    folded = F.parse_json(F.pandas_udf(fold, "string")(F.to_json("metadata"), F.coalesce("_patches", F.array().cast("array<string>"))))
    return out.withColumn("metadata", F.when(F.size("_patches") > 0, folded).otherwise(F.col("metadata"))).drop("_patches")


def failed_samples(patches: DataFrame) -> DataFrame:
    """sample_id, errors (generator, reason) of samples of which a generator failed."""
    errors = F.array_sort(F.collect_list(F.struct("rank", "generator", F.col("error").alias("reason"))))
    return patches.where("error IS NOT NULL").groupBy("sample_id").agg(F.transform(errors, lambda e: F.struct(e["generator"].alias("generator"), e["reason"].alias("reason"))).alias("errors"))


def generator_summary(patches: DataFrame) -> DataFrame:
    """generator, prepared, failed, coverage_ratio (six digits)."""
    out = patches.groupBy("generator").agg(F.count_if(F.col("error").isNull()).alias("prepared"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("n"))
    return out.select("generator", "prepared", "failed", F.round(F.col("prepared") / F.col("n"), 6).alias("coverage_ratio"))


def to_generate(wanted: DataFrame, existing: DataFrame, force: bool = False, keys=("generator", "sample_id", "view")) -> DataFrame:
    """What isn't in the output yet; all of it with ``force``."""
    return wanted if force else wanted.join(existing.select(*keys), list(keys), "left_anti")


def with_frame_guard(frames: DataFrame) -> DataFrame:
    """(sample_id, view, n_frames) with the error of clips that are too short for a depth map."""
    return frames.withColumn("error", F.when(F.col("n_frames") < 2, "at least two frames are required"))
