"""Strings, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a path says about its view, in the order of trial, and what rules it out.
VIEW_ALIASES = (
    ("camera_cross_left", ("camera_cross_left", "cross_left", "front_left", "left_front")),
    ("camera_cross_right", ("camera_cross_right", "cross_right", "front_right", "right_front")),
    ("camera_rear_left", ("camera_rear_left", "rear_left", "back_left", "left_rear")),
    ("camera_rear_right", ("camera_rear_right", "rear_right", "back_right", "right_rear")),
    ("camera_front", ("camera_front", "front", "cam_front")),
    ("camera_rear", ("camera_rear", "rear", "back")),
)
EXCLUDED_ALIASES = ("tele", "long", "zoom")


def safe_path_part(value: Column) -> Column:
    """Letters, digits, '-', '_' and '.' stay, all else becomes '_'; empty or null is 'unknown'."""
    safe = F.regexp_replace(value, r"[^\p{L}\p{N}_.-]", "_")
    return F.when(F.coalesce(F.length(safe), F.lit(0)) == 0, "unknown").otherwise(safe)


def normal_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_excluded(path: Column) -> Column:
    name = normal_name(path)
    out = F.lit(False)
    for alias in EXCLUDED_ALIASES:
        out = out | name.contains(alias)
    return out


def view_of(path: Column) -> Column:
    """The first view of which an alias is anywhere in the normalised path; null if excluded or none."""
    name, out = normal_name(path), None
    for view, aliases in VIEW_ALIASES:
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | name.contains(alias)
        out = F.when(hit, view) if out is None else out.when(hit, view)
    return F.when(~is_excluded(path), out)


def path_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def path_suffix(path: Column) -> Column:
    """The last '.' and what follows in the name, unless the name begins or ends with it."""
    return F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    name = path_name(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def normal_path(path: Column) -> Column:
    """Without empty and '.' parts, and with 'x/..' resolved."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == up) & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == up) & rooted, acc).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def sample_id(dataset: Column, path: Column) -> Column:
    """Dataset, name and the head of the path's SHA-1, joined by '_'."""
    name = F.trim(path_name(path))
    safe = F.regexp_replace(F.regexp_replace(F.when(name == "", "sample").otherwise(name), "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.concat_ws("_", dataset, F.when(safe == "", "sample").otherwise(safe), F.substring(F.sha1(path.cast("binary")), 1, 12))


def run_context(path: Column) -> Column:
    """struct(dataset_name, data_count, timestamp) of a file named name_count_timestamp, else of nulls."""
    pattern, stem = r"^([a-zA-Z0-9]+)_(\d+)_(\d+)$", path_stem(path)
    at = lambda i: F.when(stem.rlike(pattern), F.regexp_extract(stem, pattern, i))
    return F.struct(at(1).alias("dataset_name"), at(2).cast("long").alias("data_count"), at(3).alias("timestamp"))


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")
