"""Instance consistency: stability of labels, confidences and boxes of tracked objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACK_KEYS = ("sample_id", "view", "object_id")
WEIGHTS = {"class": 0.35, "confidence": 0.20, "geometry": 0.45}


def label_stability(labels: DataFrame, keys=TRACK_KEYS) -> DataFrame:
    """keys, class_score: the most frequent label's share; nulls don't count, none gives no row."""
    counts = labels.where("label IS NOT NULL").groupBy(*keys, "label").count()
    return counts.groupBy(*keys).agg((F.max("count") / F.sum("count")).alias("class_score"))


def _number(value):
    """A variant's number, of a boolean 0 or 1; anything else, numeric strings too, is null."""
    kind = F.schema_of_variant(value)
    plain = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(plain)


def _numbers(value):
    """(key, value) of an object's numbers."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _number(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())


def _text(value):
    """A variant as text: a JSON null is None, booleans are capitalised; where there is none, null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(value.isNotNull(), F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))


def top_label(value):
    """Of a variant: its label, else predicted_class, else the key of its first largest number; of a string or integer itself."""
    kind = F.schema_of_variant(value)
    pick = lambda k: _text(F.try_variant_get(value, f"$.{k}", "variant"))
    scores = _numbers(value)
    ranked = F.transform(scores, lambda e, i: F.struct(e["value"].alias("v"), (-i).alias("p"), e["key"].alias("k")))
    best = F.array_max(F.filter(ranked, lambda r: r["v"].isNotNull()))["k"]
    return F.when(kind.startswith("OBJECT"), F.coalesce(pick("label"), pick("predicted_class"), best)).when(kind.isin("STRING", "BIGINT", "BOOLEAN"), _text(value))


def confidence(value):
    """Of a variant: its confidence, else score, else its largest number; of a number itself; clipped to [0, 1]."""
    get = lambda p: _number(F.try_variant_get(value, p, "variant"))
    found = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.coalesce(get("$.confidence"), get("$.score"), F.array_max(F.transform(_numbers(value), lambda e: e["value"])))).otherwise(get("$"))
    return F.when(found.isNotNull(), F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def confidence_stability(confidences: DataFrame, keys=TRACK_KEYS) -> DataFrame:
    """keys, confidence_score: mean / (1 + population deviation) of values clipped to [0, 1]; one value is its own score."""
    clipped = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    rows = confidences.where("confidence IS NOT NULL").withColumn("_c", clipped)
    return rows.groupBy(*keys).agg((F.avg("_c") / (1 + F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_pop("_c")))).alias("confidence_score"))


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of four numbers with a frame, from bbox, else box, else boxes_2d, where an empty one falls through."""
    picked = None
    for c in ("bbox", "box", "boxes_2d"):
        if c in boxes.columns:
            one = F.when(F.size(c) > 0, F.col(c))
            picked = one if picked is None else F.coalesce(picked, one)
    return boxes.withColumn("bbox", picked).where("size(bbox) = 4 AND frame_index IS NOT NULL")


def geometry_coherence(boxes: DataFrame, keys=TRACK_KEYS, frames: DataFrame | None = None) -> DataFrame:
    """keys, geometry_score from the spread of displacement, log area and log aspect, and from gaps.

    ``boxes``: keys, frame_index, position, bbox (x1, y1, x2, y2). ``frames``: sample_id, num_frames.
    Tracks of less than two boxes have no row.
    """
    w = Window.partitionBy(*keys).orderBy("frame_index", "position")
    side = lambda a, b: F.greatest(F.col("bbox")[b] - F.col("bbox")[a], F.lit(1e-8))
    rows = boxes.select(*keys, "frame_index", "position", ((F.col("bbox")[0] + F.col("bbox")[2]) / 2).alias("cx"), ((F.col("bbox")[1] + F.col("bbox")[3]) / 2).alias("cy"), side(0, 2).alias("bw"), side(1, 3).alias("bh"))
    rows = rows.withColumn("step", F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_pop("step").alias("s_step"), F.stddev_pop(F.log(F.greatest(F.col("bw") * F.col("bh"), F.lit(1e-8)))).alias("s_area"),
        F.stddev_pop(F.log(F.greatest(F.col("bw") / F.col("bh"), F.lit(1e-8)))).alias("s_ratio"), (F.max("frame_index") - F.min("frame_index") + 1).alias("span"),
    ).where("n >= 2")
    out = out.withColumn("num_frames", F.lit(None).cast("int")) if frames is None else out.join(frames.select("sample_id", "num_frames"), "sample_id", "left")
    total = F.coalesce("num_frames", "span")
    missing = F.least(F.greatest(1 - F.col("n") / F.col("span"), F.lit(0.0)), F.lit(1.0))
    score = 0.35 / (1 + F.col("s_step")) + 0.2 / (1 + F.col("s_area")) + 0.2 / (1 + F.col("s_ratio")) + 0.15 * (1 - missing) + 0.1 * F.least(F.lit(1.0), F.col("n") / F.greatest(total, F.col("n"), F.lit(1)))
    return out.select(*keys, score.alias("geometry_score"))


def fused(classes: DataFrame, confidences: DataFrame, geometry: DataFrame, keys=TRACK_KEYS, weights=WEIGHTS) -> DataFrame:
    """keys, score: the weighted sum; a missing part counts 0 and weights are not rescaled; without any part there is no row."""
    keys = list(keys)
    out = classes.join(confidences, keys, "full_outer").join(geometry, keys, "full_outer")
    out = out.where("class_score IS NOT NULL OR confidence_score IS NOT NULL OR geometry_score IS NOT NULL")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*keys, (weights["class"] * zero("class_score") + weights["confidence"] * zero("confidence_score") + weights["geometry"] * zero("geometry_score")).alias("score"))


def tracks_union(*sources: DataFrame) -> DataFrame:
    """Track rows of several sources by name, with the rank of their source."""
    out = None
    for rank, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merged_tracks(tracks: DataFrame, keys=("sample_id", "view"), extra=(), falsy_ids=("", "0")) -> DataFrame:
    """One row a track: the first source wins unless empty, boxes are joined, attributes' last wins.

    ``tracks``: keys, source_rank, position, object_id, category, boxes, attributes, and ``extra``
    fields of JSON text, of which the first that isn't empty stays.  Blank and zero ids become
    track_0, track_1, ... in source order, which can meet a real id.  Tracks without boxes, class
    scores and identities are dropped by the caller's has_signal.
    """
    order = ["source_rank", "position"]
    falsy = F.coalesce(F.col("object_id").isin(*falsy_ids), F.lit(True))
    w = Window.partitionBy(*keys, falsy).orderBy(*order)
    rows = tracks.withColumn("object_id", F.when(falsy, F.concat(F.lit("track_"), (F.row_number().over(w) - 1).cast("string"))).otherwise(F.col("object_id")))
    held = F.array_sort(F.collect_list(F.struct(*order, "category", "boxes", F.map_entries("attributes").alias("attributes"), *extra)))
    rows = rows.groupBy(*keys, "object_id").agg(held.alias("h"))
    first = F.filter("h", lambda x: x["category"].isNotNull())
    entries = F.flatten(F.transform(F.filter("h", lambda x: x["attributes"].isNotNull()), lambda x: x["attributes"]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return rows.select(*keys, "object_id", F.try_element_at(first, F.lit(1))["category"].alias("category"), F.flatten(F.transform("h", lambda x: F.coalesce(x["boxes"], F.array().cast(tracks.schema["boxes"].dataType)))).alias("boxes"), last.alias("attributes"), *(_first_given(f).alias(f) for f in extra))


def _first_given(field: str):
    """Of the collected rows the first value that isn't null or an empty list or object."""
    return F.try_element_at(F.filter("h", lambda x: ~x[field].isin("null", "[]", "{}")), F.lit(1))[field]


def has_signal(boxes: str = "boxes", scores: str = "class_scores", identities: str = "identities"):
    return (F.coalesce(F.size(boxes), F.lit(0)) > 0) | (F.coalesce(F.size(scores), F.lit(0)) > 0) | (F.coalesce(F.size(identities), F.lit(0)) > 0)


def scored_tracks(labels: DataFrame, boxes: DataFrame, config: dict | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Track scores of ready tables of labels with confidences, and boxes, with the configured weights."""
    weights = {k: float((config or {}).get(f"{k}_weight", w)) for k, w in WEIGHTS.items()}
    return fused(label_stability(labels), confidence_stability(labels), geometry_coherence(usable_boxes(boxes), frames=frames), weights=weights)


def evaluate(samples: DataFrame, track_scores: DataFrame) -> DataFrame:
    """Track -> view -> sample, unweighted."""
    from framelens.operators.sequences import nested_mean

    out = samples.select("sample_id").join(nested_mean(track_scores, ["sample_id", "view", "object_id"]), "sample_id", "left")
    return out.select(F.lit("instance_consistency").alias("metric"), "sample_id", "score", F.when(F.col("score").isNotNull(), "success").otherwise("skipped").alias("status"), F.when(F.col("score").isNull(), "no track could be scored").alias("reason"))
