"""Pixel arithmetic of visualizations; encoding images is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.numeric import finite
from framelens.schema import VIEWS, each_view


def first_frame_gray(pixels: DataFrame, keys=("sample_id", "view")) -> DataFrame:
    """keys, y, x, gray of each clip's first frame: min-max over its finite depths; what isn't finite is 0."""
    first = pixels.join(pixels.groupBy(*keys).agg(F.min("t").alias("t")), [*keys, "t"])
    first = first.withColumn("_d", F.when(finite(F.col("depth")), F.col("depth")))
    out = first.join(first.groupBy(*keys).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")), list(keys))
    gray = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255))
    return out.select(*keys, "y", "x", F.coalesce(gray, F.lit(0)).cast("int").alias("gray"))


def mosaic(tiles: DataFrame, names=VIEWS) -> DataFrame:
    """sample_id, y, x, value of three by two tiles, in the order of the views.

    ``tiles``: sample_id, view, h, w, y, x, value.  The first view's size is the size of all tiles: a
    pixel of another view takes the nearest one of its own.  Samples without all views are left out.

    Joins merge: Spark takes exploded pixels for as small as what they are made of, and would broadcast them.
    """
    size = tiles.where(F.col("view") == names[0]).groupBy("sample_id").agg(F.max("h").alias("th"), F.max("w").alias("tw"))
    complete = tiles.groupBy("sample_id").agg(F.count_distinct(F.when(F.col("view").isin(*names), F.col("view"))).alias("n")).where(F.col("n") == len(names)).select("sample_id")
    at = each_view(size.hint("merge").join(complete, "sample_id"), names)
    at = at.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("th") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("tw") - 1)))
    shape = tiles.groupBy("sample_id", "view").agg(F.max("h").alias("vh"), F.max("w").alias("vw"))
    at = at.hint("merge").join(shape, ["sample_id", "view"]).withColumn("y", F.floor((F.col("ty") + 0.5) * F.col("vh") / F.col("th")).cast("int")).withColumn("x", F.floor((F.col("tx") + 0.5) * F.col("vw") / F.col("tw")).cast("int"))
    out = at.hint("merge").join(tiles.select("sample_id", "view", "y", "x", "value"), ["sample_id", "view", "y", "x"])
    return out.select("sample_id", (F.floor(F.col("view_rank") / 3) * F.col("th") + F.col("ty")).cast("int").alias("y"), ((F.col("view_rank") % 3) * F.col("tw") + F.col("tx")).cast("int").alias("x"), "value")


def target_status_of_parts(parts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Of a target's parts: success before partial before skipped, with the first reason by part."""
    s = F.collect_set("status")
    out = parts.groupBy(key).agg(s.alias("s"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("part", "reason")))).alias("r"))
    has = lambda x: F.array_contains("s", x)
    return out.select(key, F.when(has("success"), "success").when(has("partial"), "partial").otherwise("skipped").alias("status"), F.try_element_at("r", F.lit(1))["reason"].alias("reason"))
