"""Where results go: tables by Spark's writers, small reports as JSON files."""

from __future__ import annotations

import contextlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that go through Spark's file systems in one call, and rows that an executor renders as one text.
CHUNK, RENDERED = 1 << 20, 4096
LAYOUT = ("logs", "metrics", "summaries", "failed_samples", "references/depth", "references/semantic", "references/tracks", "visualizations/depth", "visualizations/semantic", "visualizations/match")


def make_layout(root: str) -> dict[str, str]:
    """The folders of a run, made if they are missing; a root with a scheme goes through Spark's file systems."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in LAYOUT}
    for p in paths.values():
        if is_remote(root):
            target, fs = _remote(p)
            fs.mkdirs(target)
        else:
            Path(p).mkdir(parents=True, exist_ok=True)
    return paths


def is_remote(path: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path))


def _remote(path: str):
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    if not is_remote(path):
        return Path(path).exists()
    target, fs = _remote(path)
    return fs.exists(target)


@contextlib.contextmanager
def open_bytes(path: str):
    """A function that appends bytes to a new file; a path with a scheme goes through Spark's file systems."""
    if not is_remote(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("wb") as file:
            yield file.write
        return
    target, fs = _remote(path)
    stream, held = fs.create(target, True), bytearray()

    def write(data: bytes) -> None:
        held.extend(data)
        if len(held) >= CHUNK:
            stream.write(held)
            held.clear()

    try:
        yield write
        stream.write(held)
    finally:
        stream.close()


def read_chunks(path: str) -> Iterator[bytes]:
    """The bytes of a file, a chunk at a time; a path with a scheme goes through Spark's file systems."""
    if is_remote(path):
        target, fs = _remote(path)
        stream = fs.open(target)
        read = lambda: bytes(stream.readNBytes(CHUNK))
    else:
        stream = Path(path).open("rb")
        read = lambda: stream.read(CHUNK)
    try:
        while data := read():
            yield data
    finally:
        stream.close()


@contextlib.contextmanager
def open_text(path: str):
    """The same for text."""
    with open_bytes(path) as write:
        yield lambda text: write(text.encode("utf-8"))


def _json(value, indent: int = 0) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str).replace("\n", "\n" + " " * indent)


def write_report(path: str, value) -> None:
    """Indented, non-ASCII kept, with a newline at the end."""
    with open_text(path) as write:
        write(_json(value) + "\n")


def _item(row, deep: int) -> str:
    return "\n" + " " * (deep + 2) + _json(row, deep + 2)


def _write_items(path: str, head: dict | None, field: str, items: Iterable[str]) -> None:
    deep = 2 if head is not None else 0
    with open_text(path) as write:
        if head is not None:
            write("{\n" + "".join(f"  {_json(k)}: {_json(v, 2)},\n" for k, v in head.items()) + f"  {_json(field)}: ")
        count = 0
        for item in items:
            write(("[" if not count else ",") + item)
            count += 1
        write(("\n" + " " * deep + "]" if count else "[]") + ("\n}\n" if head is not None else "\n"))


def write_rows(path: str, head: dict | None, field: str, rows: Iterable) -> None:
    """A report with a list that is written row by row: under ``field`` after ``head``, or the list alone."""
    _write_items(path, head, field, (_item(row, 2 if head is not None else 0) for row in rows))


def write_frame(path: str, head: dict, field: str, rows: DataFrame) -> None:
    """The same report of the rows of a table, in their order: executors render them, the driver holds a partition's text at a time."""

    def render(batches):
        for batch in batches:
            texts = [",".join(_item(row, 2) for row in batch.slice(lo, RENDERED).to_pylist()) for lo in range(0, batch.num_rows, RENDERED)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    _write_items(path, head, field, (r.text for r in rows.mapInArrow(render, "text string").toLocalIterator()))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by=()) -> None:
    """Parquet or JSON lines, in parts; ``by`` columns become folders."""
    df.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def enveloped(samples: DataFrame, envelope: dict | None, path: str) -> None:
    """A manifest of one file: a list, or the envelope with the samples in it; the driver holds a partition at a time."""
    rows = (json.loads(r[0]) for r in samples.select(F.to_json(F.struct("*"))).toLocalIterator())
    write_rows(path, None if envelope is None else {k: v for k, v in envelope.items() if k != "samples"}, "samples", rows)


def metric_results(summary: DataFrame) -> dict[str, dict]:
    """By metric its status, counts and mean, and the reason where it has none."""
    out = {}
    for r in summary.collect():
        row = {"metric": r.metric, "status": r.status, "num_samples": r.num_samples, "valid_sample_count": r.evaluated_count, "skipped_sample_count": r.skipped_count, "failed_sample_count": r.failed_count, f"mean_{r.metric}_score": r.mean_score}
        reason = getattr(r, "reason", None) or (None if r.mean_score is not None else f"No sample produced a valid {r.metric}_score.")
        out[r.metric] = row if reason is None else {**row, "reason": reason}
    return out


def metrics_report(summary: DataFrame, outcomes: DataFrame, path: str, context: dict | None = None) -> None:
    """The envelope of all metrics: the run's context and the results; the outcomes are a table beside it."""
    write_table(outcomes, f"{path}.outcomes", by=("metric",))
    results = metric_results(summary)
    counts = {"num_samples": max((r["num_samples"] for r in results.values()), default=0)}
    write_report(path, counts | (context or {}) | {"results": results, "details": f"{path}.outcomes"})


def summary_reports(summary: DataFrame, failed: DataFrame, folder: str, context: dict | None = None) -> None:
    """summary.json: the context and each metric's status and scalars, with those that failed once more; failed_samples.json: what was skipped or failed."""
    results = metric_results(summary)
    body = {m: {k: v for k, v in r.items() if k != "metric"} for m, r in results.items()}
    counts = {"num_samples": max((r["num_samples"] for r in results.values()), default=0)}
    head = counts | (context or {})
    write_report(f"{folder}/summary.json", head | {"summary": body | {"_failed_metrics": {m: r for m, r in body.items() if r["status"] == "failed"}}})
    write_table(failed, f"{folder}/failed_samples", "json")
    write_frame(f"{folder}/failed_samples.json", head, "failed_samples", failed.orderBy("metric", "status", "sample_id"))


def write_tensors(frames: DataFrame, folder: str, keys=("generator", "sample_id", "view")) -> DataFrame:
    """Packed frames (keys, t, h, w, values) as rows of (keys, npy): one .npy image a sequence, for a binary sink."""
    kinds = ", ".join(f"{k} string" for k in keys)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = io.BytesIO()
        np.save(out, np.stack([np.asarray(v).reshape(h, w) for v, h, w in zip(pdf["values"], pdf["h"], pdf["w"])]))
        return pd.DataFrame({**{k: [str(pdf[k].iloc[0])] for k in keys}, "npy": [out.getvalue()]})

    packed = frames.groupBy(*keys).applyInPandas(pack, f"{kinds}, npy binary")
    packed.write.mode("overwrite").partitionBy(*keys).parquet(folder)
    return packed.sparkSession.read.parquet(folder)


def png(values: np.ndarray) -> bytes:
    """A PNG image of 8-bit gray (h, w) or colour (h, w, 3) values."""
    values = np.ascontiguousarray(np.clip(values, 0, 255), np.uint8)
    h, w = values.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), values.reshape(h, -1)], axis=1)  # no filter before each line
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if values.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded_images(images: DataFrame, channels: int = 1) -> DataFrame:
    """``images`` (keys, h, w, values) with png instead of values, which are rows of pixels."""

    def run(batches):
        for part in batches:
            shape = lambda h, w: (h, w) if channels == 1 else (h, w, channels)
            part["png"] = [png(np.asarray(v).reshape(shape(h, w))) for v, h, w in zip(part["values"], part["h"], part["w"])]
            yield part.drop(columns="values")

    kinds = T.StructType([*[f for f in images.schema.fields if f.name != "values"], T.StructField("png", T.BinaryType())])
    return images.mapInPandas(run, kinds)


def write_images(images: DataFrame, folder: str, name: str = "name") -> None:
    """Files ``name``.png of ``encoded_images`` in a folder; the driver holds a partition at a time."""
    for r in images.select(name, "png").toLocalIterator():
        with open_bytes(f"{folder}/{r[0]}.png") as write:
            write(bytes(r[1]))
