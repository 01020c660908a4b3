"""Plug-ins: metrics, reference generators and visualizers by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.operators import coherence, depth, facts, instances, integrity, semantic, temporal, views
from framelens.plans import visual
from framelens.schema import VIEWS

#: A metric takes samples, its fact tables by name, and its configuration, and gives outcome rows.
Metric = Callable[[DataFrame, dict, dict], DataFrame]

def _views(config: dict) -> tuple[str, ...]:
    return tuple(config.get("expected_camera_views") or VIEWS)


def _integrity(samples, tables, config):
    tolerance = {k: float(config.get(f"{k}_tolerance", 0.05)) for k in ("frame_count", "fps", "duration")}
    return integrity.evaluate(samples, tables["inventory"], _views(config), tolerance)


def _coherence(samples, tables, config):
    """Of a table of object features, or of metadata."""
    if "object_features" in tables:
        return coherence.evaluate(samples, tables["object_features"])
    return facts.coherence_outcomes(samples, str(config.get("object_features_key", "object_features")), _views(config), float(config.get("eps", 1e-8)))


def _instances(samples, tables, config):
    """Of track scores, of labels and boxes, or of metadata."""
    if "track_scores" in tables:
        return instances.evaluate(samples, tables["track_scores"])
    if "labels" in tables:
        return instances.evaluate(samples, instances.scored_tracks(tables["labels"], tables["boxes"], config, tables.get("num_frames")))
    return facts.consistency_outcomes(samples, config, _views(config))


def _semantic(samples, tables, config):
    """Of mask scores, of packed masks, or of metadata, whose paths ``tensors`` has."""
    if "mask_scores" in tables:
        return semantic.evaluate(samples, tables["mask_scores"], tables["num_classes"])
    if "masks" in tables:
        masks = tables["masks"]
        scores = semantic.clip_scores(masks.where("num_classes > 0"), ignore=int(config.get("ignore_label", semantic.IGNORE)), min_iou=float(config.get("min_iou", 0.1)), erosion=int(config.get("erosion_k", 2)))
        return semantic.evaluate(samples, scores, masks.select("sample_id", "view", "num_classes").distinct())
    return facts.semantic_outcomes(samples, config, _views(config), tables.get("tensors"))


def _depth(samples, tables, config):
    """Of depth scores, or of embeddings of depth maps and of videos, where maps come first."""
    if "depth_scores" in tables:
        return depth.evaluate(samples, tables["depth_scores"])
    scale = float(config.get("depth_l2_scale", 1.0))
    scored = {k: depth.clip_scores(tables[k], scale) for k in ("map_embeddings", "video_embeddings") if k in tables}
    both = depth.map_else_video(*scored.values()) if len(scored) == 2 else next(iter(scored.values()))
    return depth.evaluate(samples, both)


METRICS: dict[str, Metric] = {
    "video_integrity": _integrity,
    "temporal_consistency": lambda s, t, c: temporal.evaluate(s, t["features"], _views(c)),
    "instance_coherence": _coherence,
    "instance_consistency": _instances,
    "semantic_consistency": _semantic,
    "depth_consistency": _depth,
    "view_consistency": lambda s, t, c: views.evaluate(s, t["matches"], int(c.get("match_count_ref", 50))),
}
#: A generator gives patch rows (sample_id, generator, rank, patch, error).
GENERATORS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
#: A visualizer takes samples, the tables by name and its configuration, and gives pixels.
VISUALIZERS: dict[str, Callable[[DataFrame, dict, dict], DataFrame]] = {
    "depth_first_frame": lambda s, t, c: visual.first_frame_gray(t["depth_pixels"]),
    "mosaic": lambda s, t, c: visual.mosaic(t["tiles"], _views(c)),
}


def register(kind: dict, name: str, function: Callable) -> None:
    if name in kind:
        raise ValueError(f"{name!r} is registered already")
    kind[name] = function


def build(kind: dict, name: str) -> Callable:
    if name not in kind:
        raise ValueError(f"unknown name {name!r}; known: {', '.join(sorted(kind))}")
    return kind[name]


def enabled(configs: dict[str, dict], default: bool = False) -> list[str]:
    """Names whose configuration enables them: metrics are off by default, generators on."""
    return [name for name, c in configs.items() if (c or {}).get("enabled", default)]


def last_configs(configs: list[dict]) -> list[dict]:
    """One configuration a name: the last one, at the place of the first."""
    out: dict[str, dict] = {}
    for c in configs:
        out[c["name"]] = c
    return list(out.values())


def grouped_model(frames: DataFrame, keys: Sequence[str], order: str, load: Callable[[], Callable[[list[bytes]], list[dict]]], output: str) -> DataFrame:
    """Rows that a model gives for whole clips or pairs of clips: keys and ``output`` (a schema).

    ``frames``: keys, ``order``, frame.  The model is loaded once a task and called once a group with
    the frames in order; a group, which is a clip, is all that a task holds.
    """
    kinds = T.StructType([*(frames.schema[k] for k in keys), *T._parse_datatype_string(output).fields])
    loaded: list = []

    def run(group):
        if not loaded:
            loaded.append(load())
        found = loaded[0](group.sort_values(order)["frame"].tolist())
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, **row} for row in found], columns=kinds.names)

    return frames.select(*keys, order, "frame").groupBy(*keys).applyInPandas(run, kinds)


def clip_depths(frames: DataFrame, load: Callable[[], Callable[[list[bytes]], list[dict]]], keys: Sequence[str] = ("sample_id", "view")) -> DataFrame:
    """keys, t, h, w, depth: the maps that a video depth model gives for each clip of ``frames`` (keys, t, frame)."""
    return grouped_model(frames, keys, "t", load, "t int, h int, w int, depth array<double>")


def pair_matches(pairs: DataFrame, load: Callable[[], Callable[[list[bytes]], list[dict]]]) -> DataFrame:
    """sample_id, cam_a, cam_b, t, mconf: the confidences of a matcher for each pair of frames.

    ``pairs``: sample_id, cam_a, cam_b, t, frame_a, frame_b; the matcher takes both frames at once.
    """
    two = F.posexplode(F.array("frame_a", "frame_b")).alias("side", "frame")
    return grouped_model(pairs.select("sample_id", "cam_a", "cam_b", "t", two), ["sample_id", "cam_a", "cam_b", "t"], "side", load, "mconf array<double>")


def encoded(frames: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[float]]]], batch: int = 16) -> DataFrame:
    """``frames`` (keys, frame) with feature, by an encoder that is loaded once a task and called in batches.

    Any model can be plugged in; none is part of the library.
    """

    def run(batches):
        model = load()
        for part in batches:
            rows = part["frame"].tolist()
            part["feature"] = [v for lo in range(0, len(rows), batch) for v in model(rows[lo : lo + batch])]
            yield part.drop(columns="frame")

    kinds = T.StructType([*[f for f in frames.schema.fields if f.name != "frame"], T.StructField("feature", T.ArrayType(T.DoubleType()))])
    return frames.mapInPandas(run, kinds)
