"""Files: listings, tensors, and video properties. Reading is distributed by Spark's binaryFile source."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions.text import path_suffix
from framelens.schema import VIEWS

#: Bytes of decoded frames that are passed on at once.
_FRAMES = 1 << 24
#: Suffixes of videos.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files below; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def by_parts(path):
    """What to sort a path by: its parts, not its characters."""
    return F.split(path, "/")


def candidates(files: DataFrame, key: str = "video") -> DataFrame:
    """Of each key's files (key, path) the videos, or all where there is no video."""
    is_video = F.lower(path_suffix(F.col("path"))).isin(*VIDEO_SUFFIXES)
    any_video = F.max(is_video.cast("int")).over(Window.partitionBy(key))
    return files.withColumn("_v", is_video).withColumn("_any", any_video == 1).where("_v OR NOT _any").drop("_v", "_any")


def view_images(files: DataFrame, part: str | None = None) -> DataFrame:
    """Images, of a sample if ``part`` is given, whose path holds it; sorted by path parts."""
    out = files if part is None else files.where(F.col("path").contains(part))
    return out.orderBy(by_parts(F.col("path")))


def first_of_view(files: DataFrame, names=VIEWS) -> DataFrame:
    """``files`` (sample_id, path) to the first path of each sample and view whose name is in it; longer names don't shield shorter ones."""
    hits = files.select("sample_id", "path", F.explode(F.filter(F.array(*[F.lit(v) for v in names]), lambda v: F.contains(F.col("path"), v))).alias("view"))
    n = F.row_number().over(Window.partitionBy("sample_id", "view").orderBy(by_parts(F.col("path")), "path"))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")


def png_pixels(content: bytes) -> np.ndarray:
    """Values of a PNG image of 8-bit gray or colour without filters, such as ``sinks.png`` makes; others raise."""
    at, data, shape = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", body[:10])
            if depth != 8 or colour not in (0, 2):
                raise ValueError("only 8-bit gray and colour images")
            shape = (h, w) if colour == 0 else (h, w, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], -1)
    if lines[:, 0].any():
        raise ValueError("only lines without filters")
    return lines[:, 1:].reshape(shape)


def _array(path: str, content: bytes) -> np.ndarray:
    return np.asarray(json.loads(content)) if path.endswith(".json") else np.load(io.BytesIO(content), allow_pickle=False)


def tensors_of(contents: DataFrame, kind: str = "int") -> DataFrame:
    """``contents`` (path, content) to (path, t, h, w, values, error), a frame of every tensor of three dimensions.

    A path that ends in .json holds nested lists, any other .npy. What can't be read gives one row with
    an error. Pickled contents are refused.
    """
    dtype = np.int32 if kind == "int" else np.float64

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    a = _array(p, content)
                    if a.ndim != 3:
                        raise ValueError(f"expected three dimensions, got {a.ndim}")
                    for lo in range(0, len(a), 64):
                        part = a[lo : lo + 64].astype(dtype)
                        yield pd.DataFrame({"path": p, "t": np.arange(lo, lo + len(part)), "h": a.shape[1], "w": a.shape[2], "values": list(part.reshape(len(part), -1)), "error": None})
                except Exception as e:  # noqa: BLE001  any unreadable file is a row
                    yield pd.DataFrame({"path": [p], "t": [None], "h": [None], "w": [None], "values": [None], "error": [f"{type(e).__name__}: {e}"]}).astype({"t": "Int32", "h": "Int32", "w": "Int32"})

    return contents.select("path", "content").mapInPandas(run, f"path string, t int, h int, w int, values array<{kind}>, error string")


def tensors(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """The frames of all .npy and .json files below."""
    return tensors_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.{npy,json}").option("recursiveFileLookup", "true").load(path), kind)


def frames(spark: SparkSession, path: str, decode: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, frame_index, frame) by a decoder given; none is part of the library. Frames come in batches of bounded size."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                held, size, first = [], 0, 0
                for frame in decode(content):
                    held.append(frame)
                    size += len(frame)
                    if size >= _FRAMES:
                        yield pd.DataFrame({"path": p, "frame_index": range(first, first + len(held)), "frame": held})
                        first, held, size = first + len(held), [], 0
                if held:
                    yield pd.DataFrame({"path": p, "frame_index": range(first, first + len(held)), "frame": held})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, frame_index int, frame binary")


def probed(spark: SparkSession, path: str, probe: Callable[[bytes], dict], backend: str) -> DataFrame:
    """(path, frame_count, fps, width, height, backend, reason) of all files below, by a probe given; what it raises is the reason."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    found = probe(content)
                    rows.append((p, *(found.get(k) for k in ("frame_count", "fps", "width", "height")), backend, None))
                except Exception as e:  # noqa: BLE001  any unreadable file is a row
                    rows.append((p, None, None, None, None, backend, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "frame_count", "fps", "width", "height", "backend", "reason"]).astype({"frame_count": "Int32", "fps": "Float64", "width": "Int32", "height": "Int32"})

    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return contents.mapInPandas(run, "path string, frame_count int, fps double, width int, height int, backend string, reason string")


def video_properties(probed: DataFrame) -> DataFrame:
    """Adds duration (frames over fps where both are positive) and readable (frames, width and height positive)."""
    both = (F.col("fps") > 0) & (F.col("frame_count") > 0)
    seen = (F.col("width") > 0) & (F.col("height") > 0)
    readable = seen & F.when(F.col("backend") == "imageio", True).otherwise(F.col("frame_count") > 0)
    return probed.withColumn("duration", F.when(both, F.col("frame_count") / F.col("fps"))).withColumn("readable", F.coalesce(readable, F.lit(False)))


