"""From the metadata of samples to the fact tables of the metrics: features, tracks and masks.

Metadata is a VARIANT whose shape is only known by looking: view maps or the older forms without
views, lists or scalars, inline tensors or paths.  Values of any depth are read by vectorised functions
over their JSON text; all else is expressions and joins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.operators import instances, semantic
from framelens.operators.sequences import nested_mean, sequence_scores
from framelens.schema import VIEWS
from framelens.sources.manifest import at, kind

EMPTY = ("null", "[]", "{}", '""', "0", "false")


def _vectorised(kind: str):
    """A function over series of JSON text, made a user function when it is first applied (a session is needed for that)."""
    return lambda function: lambda *columns: F.pandas_udf(function, kind)(*columns)


def _entries(value: Column) -> Column:
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def _is(value: Column, name: str) -> Column:
    return F.coalesce(kind(value).startswith(name), F.lit(False))


def _views(value: Column, views: Sequence[str]) -> Column:
    """(view, value) of an object's expected views, in their order."""
    return F.filter(F.array(*[F.struct(F.lit(v).alias("view"), at(value, f"$.{v}").alias("value")) for v in views]), lambda x: x["value"].isNotNull())


# Instance coherence


@_vectorised("struct<error string, frames array<array<double>>>")
def _sequence(values: pd.Series) -> pd.DataFrame:
    """Frames of a nested list of numbers; what has one frame or none that counts gives none, what NumPy refuses an error."""
    rows = []
    for text in values:
        error, frames = None, None
        try:
            x = np.asarray(None if text is None else json.loads(text), dtype=np.float64)
            if x.ndim > 1 and len(x) > 1 and x.size:
                frames = x.reshape(len(x), -1)
        except (TypeError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        rows.append((error, None if frames is None else frames.tolist()))
    return pd.DataFrame(rows, columns=["error", "frames"])


def object_features(samples: DataFrame, key: str = "object_features", views: Sequence[str] = VIEWS) -> DataFrame:
    """(sample_id, view, object_id, error, frames) of ``samples`` (sample_id, metadata); a null view is the form without views."""
    top = at(F.col("metadata"), f"$.{key}")
    rows = samples.where(_is(top, "OBJECT")).select("sample_id", top.alias("top"))
    by_view = rows.select("sample_id", F.explode(_views(F.col("top"), views)).alias("v")).where(_is(F.col("v.value"), "OBJECT"))
    by_view = by_view.select("sample_id", F.col("v.view").alias("view"), F.explode(_entries(F.col("v.value"))).alias("e"))
    older = rows.select("sample_id", F.lit(None).cast("string").alias("view"), F.explode(_entries(F.col("top"))).alias("e"))
    out = by_view.unionByName(older).select("sample_id", "view", F.col("e.key").alias("object_id"), F.to_json("e.value").alias("text"))
    return out.withColumn("s", _sequence("text")).select("sample_id", "view", "object_id", "s.error", "s.frames")


def coherence_outcomes(samples: DataFrame, key: str = "object_features", views: Sequence[str] = VIEWS, eps: float = 1e-8) -> DataFrame:
    """Outcome rows of instance coherence from metadata.

    A value that can't be read as numbers fails its sample: in a view at once, in the older form if no
    view scored (where the views themselves are such values).
    """
    found = object_features(samples, key, views)
    frames = found.where("frames IS NOT NULL").select("sample_id", "view", "object_id", F.posexplode("frames").alias("t", "feature"))
    scores = sequence_scores(frames, ["sample_id", "view", "object_id"], ["t"], "feature", eps=eps)
    by_view = nested_mean(scores.where("view IS NOT NULL"), ["sample_id", "view", "object_id"]).withColumnRenamed("score", "viewed")
    older = nested_mean(scores.where("view IS NULL").select("sample_id", "object_id", "score"), ["sample_id", "object_id"]).withColumnRenamed("score", "older")
    errors = found.groupBy("sample_id").agg(F.min(F.when(F.col("view").isNotNull(), F.col("error"))).alias("view_error"), F.min(F.when(F.col("view").isNull(), F.col("error"))).alias("older_error"))
    top = at(F.col("metadata"), f"$.{key}")
    given = _is(top, "OBJECT") & (F.coalesce(F.size(_entries(top)), F.lit(0)) > 0)
    out = samples.select("sample_id", given.alias("given")).join(errors, "sample_id", "left").join(by_view, "sample_id", "left").join(older, "sample_id", "left")
    error = F.when(F.col("view_error").isNotNull(), F.col("view_error")).when(F.col("viewed").isNull(), F.col("older_error"))
    score = F.when(F.col("given") & error.isNull(), F.coalesce("viewed", "older"))
    reason = F.when(~F.col("given"), f"metadata['{key}'] must be a non-empty dict.").when(error.isNotNull(), error).when(score.isNull(), f"No usable object feature sequence found in metadata['{key}'].")
    status = F.when(~F.col("given"), "skipped").when(error.isNotNull(), "failed").when(score.isNull(), "skipped").otherwise("success")
    return out.select(F.lit("instance_coherence").alias("metric"), "sample_id", score.alias("score"), status.alias("status"), reason.alias("reason"))


# Instance consistency


def _label(value) -> str | None:
    if isinstance(value, dict):
        for name in ("label", "predicted_class"):
            if name in value:
                return str(value[name])
        best = max(((float(v), -i, k) for i, (k, v) in enumerate(value.items()) if isinstance(v, (int, float)) and not math.isnan(v)), default=None)
        return best[2] if best else None
    return str(value) if isinstance(value, (str, int)) else None


def _confidences(value) -> list[float]:
    if isinstance(value, dict):
        own = next((value[n] for n in ("confidence", "score") if isinstance(value.get(n), (int, float))), None)
        numbers = [own] if own is not None else [max(x)] if (x := [v for v in value.values() if isinstance(v, (int, float))]) else []
    elif isinstance(value, list):
        return [c for x in value for c in _confidences(x)]
    else:
        numbers = [value] if isinstance(value, (int, float)) else []
    return [min(max(float(x), 0.0), 1.0) for x in numbers]


def signals(class_scores, identities) -> tuple[float | None, float | None]:
    """(class stability, confidence stability) of a track's raw values.

    Class scores come before identities even where they give no label.  Of an object each value is one
    observation, of a list each item; anything else is one itself.  A scalar identity is stable.
    """
    stable = confident = None
    labels = identities
    if class_scores is not None:
        items = list(class_scores.values()) if isinstance(class_scores, dict) else class_scores if isinstance(class_scores, list) else [class_scores]
        labels = [x for x in map(_label, items) if x is not None]
        found = [c for x in items for c in _confidences(x)]
        if found:
            confident = found[0] if len(found) == 1 else float(np.mean(found) / (1 + np.std(found)))
    if isinstance(labels, (str, int, float)):
        stable = 1.0
    elif isinstance(labels, list):
        names = [str(x) for x in labels if x is not None]
        stable = max(map(names.count, set(names))) / len(names) if names else None
    return stable, confident


@_vectorised("struct<class_score double, confidence_score double>")
def _signals(scores: pd.Series, identities: pd.Series) -> pd.DataFrame:
    read = lambda x: None if x is None else json.loads(x)
    return pd.DataFrame([signals(read(a), read(b)) for a, b in zip(scores, identities)], columns=["class_score", "confidence_score"], dtype=float)


_BOX = "array<struct<frame_index:int,bbox:array<double>>>"
FIELDS = ("class_scores", "identities", "crops")


def _track_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (sample_id, view, source_rank, position, item) as typed tracks; side fields stay JSON text."""
    text = lambda name: F.to_json(at(F.col("item"), f"$.{name}"))
    box = lambda b: F.struct(F.try_variant_get(b, "$.frame_index", "int").alias("frame_index"), F.coalesce(*[F.when(F.size(x) > 0, x) for x in (F.try_variant_get(b, f"$.{n}", "array<double>") for n in ("bbox", "box", "boxes_2d"))]).alias("bbox"))
    listed = F.coalesce(F.try_variant_get("item", "$.boxes", "array<variant>"), F.when(at(F.col("item"), "$.boxes").isNull(), F.try_variant_get("item", "$.boxes_2d", "array<variant>")))
    raw = at(F.col("item"), "$.object_id")
    truthy = raw.isNotNull() & ~F.to_json(raw).isin(*EMPTY)
    return rows.select(
        "sample_id", "view", "source_rank", "position", F.when(truthy, F.coalesce(F.try_variant_get(raw, "$", "string"), F.to_json(raw))).alias("object_id"),
        F.try_variant_get("item", "$.category", "string").alias("category"), F.transform(F.filter(listed, lambda b: _is(b, "OBJECT")), box).alias("boxes"), F.try_variant_get("item", "$.attributes", "map<string,string>").alias("attributes"),
        *(F.when(~text(name).isin("null"), text(name)).alias(name) for name in FIELDS),
    )


def with_side_values(tracks: DataFrame, side: DataFrame, field: str) -> DataFrame:
    """``side`` (sample_id, view, object_id, value) into ``field``: of the last track with that id, else of a new track."""
    keys = ["sample_id", "view", "object_id"]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("source_rank"), F.desc("position")))
    rows = tracks.withColumn("_last", F.col("object_id").isNotNull() & (last == 1))
    given = side.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("value").alias("_value"))
    same = F.col("sample_id") == F.col("_sample_id")
    for k in keys[1:]:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.join(given, same, "full_outer")
    new = F.col("sample_id").isNull()
    own = {k: F.coalesce(k, f"_{k}") for k in ("sample_id", "view")} | {"object_id": F.when(new, F.col("_object_id")).otherwise(F.col("object_id")), "source_rank": F.coalesce("source_rank", F.lit(9)), "position": F.coalesce("position", F.lit(0))}
    own[field] = F.when(new | F.col("_last"), F.coalesce("_value", field)).otherwise(F.col(field))
    return rows.select(*(own.get(c, F.col(c)).alias(c) for c in tracks.columns))


def tracks(samples: DataFrame, config: dict | None = None, views: Sequence[str] = VIEWS, by_view: bool = True) -> DataFrame:
    """Merged tracks with a signal: sample_id, view, object_id, category, boxes, attributes, class_scores, identities, crops.

    From metadata's lists of tracks by view and its side maps; without ``by_view`` from the sample's own
    objects, lists that aren't by view, and flat side maps, with a null view.
    """
    c = config or {}
    keys = [c.get(f"{k}_key", k) for k in ("instance_tracks", "object_tracks", "objects")]
    side_keys = [c.get(f"object_{f}_key", f"object_{f}") for f in FIELDS]
    meta, none = F.col("metadata"), F.lit(None).cast("string").alias("view")
    parts = []
    for rank, k in enumerate(keys, 1):
        if by_view:
            rows = samples.select("sample_id", F.explode(_views(at(meta, f"$.{k}"), views)).alias("v")).select("sample_id", F.col("v.view").alias("view"), F.col("v.value").alias("top"))
        else:
            rows = samples.select("sample_id", none, at(meta, f"$.{k}").alias("top"))
        items = F.when(_is(F.col("top"), "ARRAY"), F.try_variant_get("top", "$", "array<variant>"))
        parts.append(_track_rows(rows.select("sample_id", "view", F.lit(rank).alias("source_rank"), F.posexplode(items).alias("position", "item")).where(_is(F.col("item"), "OBJECT"))))
    if not by_view and "objects" in samples.columns:
        rows = samples.select("sample_id", none, F.lit(0).alias("source_rank"), F.posexplode("objects").alias("position", "o"))
        parts.append(rows.select("sample_id", "view", "source_rank", "position", F.when(~F.col("o.object_id").isin("", "0"), F.col("o.object_id")).alias("object_id"), "o.category", F.col("o.boxes").cast(_BOX).alias("boxes"), "o.attributes", *(F.lit(None).cast("string").alias(f) for f in FIELDS)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    for field, k in zip(FIELDS, side_keys):
        if by_view:
            rows = samples.select("sample_id", F.explode(_views(at(meta, f"$.{k}"), views)).alias("v")).select("sample_id", F.col("v.view").alias("view"), F.col("v.value").alias("top"))
        else:
            rows = samples.select("sample_id", none, at(meta, f"$.{k}").alias("top"))
        side = rows.where(_is(F.col("top"), "OBJECT")).select("sample_id", "view", F.explode(_entries(F.col("top"))).alias("e")).select("sample_id", "view", F.col("e.key").alias("object_id"), F.to_json("e.value").alias("value"))
        out = with_side_values(out, side.where("value <> 'null'"), field)
    merged = instances.merged_tracks(out, ["sample_id", "view"], FIELDS, ("",))
    given = lambda f: F.coalesce(~F.col(f).isin("null", "[]", "{}"), F.lit(False))
    return merged.where((F.size("boxes") > 0) | given("class_scores") | given("identities"))


def track_scores(found: DataFrame, samples: DataFrame, weights: dict) -> DataFrame:
    """sample_id, view, object_id, score of ``tracks``; a track without any part has no row."""
    keys = ["sample_id", "view", "object_id"]
    found = found.withColumn("view", F.coalesce("view", F.lit("")))
    raw = found.select(*keys, _signals("class_scores", "identities").alias("s")).select(*keys, "s.*")
    boxes = found.select(*keys, F.posexplode("boxes").alias("position", "b")).select(*keys, "position", "b.frame_index", "b.bbox")
    frames = samples.select("sample_id", F.try_variant_get("metadata", "$.num_frames", "int").alias("num_frames"))
    geometry = instances.geometry_coherence(instances.usable_boxes(boxes), keys, frames)
    return instances.fused(raw.select(*keys, "class_score"), raw.select(*keys, "confidence_score"), geometry, keys, weights)


def consistency_outcomes(samples: DataFrame, config: dict | None = None, views: Sequence[str] = VIEWS) -> DataFrame:
    """Outcome rows of instance consistency from metadata: by view, and where no view scores by the older form.

    ``num_frames`` that is given but null fails a sample with a track of two boxes.
    """
    c = config or {}
    weights = {k: float(c.get(f"{k}_weight", w)) for k, w in instances.WEIGHTS.items()}
    parts = []
    for by_view in (True, False):
        found = tracks(samples, c, views, by_view)
        per = nested_mean(track_scores(found, samples, weights), ["sample_id", "view", "object_id"])
        two = F.size(F.filter("boxes", lambda b: (F.size(b["bbox"]) == 4) & b["frame_index"].isNotNull())) >= 2
        parts.append((found.groupBy("sample_id").agg(F.max(two).alias("two")), per))
    (seen, viewed), (older_seen, older) = parts
    out = samples.select("sample_id", (kind(at(F.col("metadata"), "$.num_frames")) == "VOID").alias("void"))
    out = out.join(seen, "sample_id", "left").join(viewed, "sample_id", "left")
    out = out.join(older_seen.withColumnRenamed("two", "older_two"), "sample_id", "left").join(older.withColumnRenamed("score", "older"), "sample_id", "left")
    bad = F.coalesce(F.col("void"), F.lit(False)) & (F.coalesce("two", F.lit(False)) | (F.col("score").isNull() & F.coalesce("older_two", F.lit(False))))
    score = F.when(~bad, F.coalesce("score", "older"))
    reason = F.when(bad, "int() argument must be a string, a bytes-like object or a real number, not 'NoneType'")
    reason = reason.when(score.isNull() & F.col("older_two").isNull(), "No usable prepared tracks found for expected views or legacy fallback.").when(score.isNull(), "No usable track-level signals were available for scoring.")
    status = F.when(bad, "failed").when(score.isNull(), "skipped").otherwise("success")
    return out.select(F.lit("instance_consistency").alias("metric"), "sample_id", score.alias("score"), status.alias("status"), reason.alias("reason"))


# Semantic consistency


@_vectorised("struct<error string, frames array<struct<t int, h int, w int, mask array<int>>>>")
def _masks(values: pd.Series) -> pd.DataFrame:
    rows = []
    for text in values:
        error, frames = None, None
        try:
            x = np.asarray(json.loads(text))
            if x.ndim == 3:
                frames = [{"t": t, "h": f.shape[0], "w": f.shape[1], "mask": f.ravel().tolist()} for t, f in enumerate(x.astype(np.int32))]
        except (TypeError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        rows.append((error, frames))
    return pd.DataFrame(rows, columns=["error", "frames"])


def mask_frames(samples: DataFrame, key: str = "semantic_masks", views: Sequence[str] = VIEWS, tensors: DataFrame | None = None) -> DataFrame:
    """(sample_id, view, error, t, h, w, mask): inline masks, and those of paths that ``tensors`` (path, t, h, w, values) has.

    A null view is the form without views. What is no tensor of three dimensions gives no row, what
    NumPy refuses a row with the error.
    """
    top = at(F.col("metadata"), f"$.{key}")
    by_view = samples.where(_is(top, "OBJECT")).select("sample_id", F.explode(_views(top, views)).alias("v")).select("sample_id", "v.view", "v.value")
    rows = by_view.unionByName(samples.where(~_is(top, "OBJECT")).select("sample_id", F.lit(None).cast("string").alias("view"), top.alias("value")))
    inline = rows.where(_is(F.col("value"), "ARRAY")).select("sample_id", "view", _masks(F.to_json("value")).alias("m"))
    out = inline.select("sample_id", "view", "m.error", F.explode_outer("m.frames").alias("f")).select("sample_id", "view", "error", "f.*").where("error IS NOT NULL OR mask IS NOT NULL")
    if tensors is None:
        return out
    paths = rows.where(kind(F.col("value")) == "STRING").select("sample_id", "view", F.try_variant_get("value", "$", "string").alias("path"))
    read = paths.join(tensors, "path").select("sample_id", "view", F.lit(None).cast("string").alias("error"), "t", "h", "w", F.col("values").cast("array<int>").alias("mask"))
    return out.unionByName(read.where("mask IS NOT NULL"))


def semantic_outcomes(samples: DataFrame, config: dict | None = None, views: Sequence[str] = VIEWS, tensors: DataFrame | None = None) -> DataFrame:
    """Outcome rows of semantic consistency from metadata; a view without classes fails its sample, as does a ragged mask."""
    c = config or {}
    ignore, keys = int(c.get("ignore_label", semantic.IGNORE)), ["sample_id", "view"]
    declared = lambda name, view: F.when(_is(at(F.col("metadata"), f"$.{name}"), "OBJECT"), F.try_element_at(F.try_variant_get("metadata", f"$.{name}", "map<string,int>"), view)).otherwise(F.try_variant_get("metadata", f"$.{name}", "int"))
    frames = mask_frames(samples, c.get("semantic_masks_key", "semantic_masks"), views, tensors).withColumn("view", F.coalesce("view", F.lit("")))
    errors = frames.groupBy("sample_id").agg(F.min("error").alias("error"))
    clips = frames.where("error IS NULL").groupBy(*keys).agg((F.max(F.array_max(F.filter("mask", lambda x: x != ignore))) + 1).alias("_most"))
    clips = clips.join(samples.select("sample_id", "metadata"), "sample_id")
    clips = clips.withColumn("num_classes", F.coalesce(declared(c.get("num_classes_key", "semantic_num_classes"), F.col("view")), F.col("_most"), F.lit(0)))
    clips = clips.withColumn("label", F.coalesce(declared(c.get("ignore_label_key", "semantic_ignore_label"), F.col("view")), F.lit(ignore))).where(F.col("label") == ignore).select(*keys, "num_classes")
    packed = frames.where("error IS NULL").join(clips.where("num_classes > 0"), keys).select(*keys, "t", "h", "w", "mask", "num_classes")
    scores = semantic.clip_scores(packed, keys, ignore, float(c.get("min_iou", 0.1)), erosion=int(c.get("erosion_k", 2)))
    bad = clips.where("num_classes <= 0").select("sample_id").distinct().withColumn("bad", F.lit(True))
    per = scores.groupBy("sample_id").agg(F.avg("score").alias("mean"))
    out = samples.select("sample_id").join(errors, "sample_id", "left").join(bad, "sample_id", "left").join(per, "sample_id", "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("bad"), "ValueError: num_classes must be positive after ignoring invalid pixels.")
    score = F.when(reason.isNull(), F.col("mean"))
    status = F.when(reason.isNotNull(), "failed").when(score.isNull(), "skipped").otherwise("success")
    return out.select(F.lit("semantic_consistency").alias("metric"), "sample_id", score.alias("score"), status.alias("status"), F.coalesce(reason, F.when(score.isNull(), "No evaluable prepared semantic data found.")).alias("reason"))
