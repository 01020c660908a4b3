"""Sample manifests: JSON to rows, validation with reasons, normalisation.

A record is a VARIANT, so that missing, null and wrongly typed values can be told apart.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.schema import VIEWS
from framelens.sources.sinks import exists, open_text, read_chunks

#: Keys that can hold the list of an index, in the order of trial.
CONTAINERS = ("samples", "data", "items", "records", "infos", "entries")


#: Fixed value: what a manifest must be.
SHAPE = "Data JSON must be a top-level list or an object containing a 'samples' list."


def kind(value: Column) -> Column:
    """The type of a VARIANT: VOID for a JSON null, null where there is none."""
    return F.schema_of_variant(value)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of whole JSON files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("payload"))


def entries(chunks: Iterable[bytes], field: str) -> Iterator[tuple]:
    """(key, value) of a JSON object that comes in chunks; for ``field``, if it holds a list, (field, item) by item."""
    chunks, decoder, scan = iter(chunks), codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder().raw_decode
    text, at, ended = "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        data = next(chunks, b"")
        ended = not data
        text, at = text[at:] + decoder.decode(data, ended), 0

    def ahead() -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\n\r":
                at += 1
            if at < len(text) or ended:
                return text[at : at + 1]
            more()

    def taken(of: str) -> str:
        nonlocal at
        if not (found := ahead()) or found not in of:
            raise ValueError(f"no JSON object: {found!r} where one of {of!r} should be")
        at += 1
        return found

    def value():
        nonlocal at
        while True:
            ahead()
            try:
                found, end = scan(text, at)
            except json.JSONDecodeError:
                if ended:
                    raise
            else:
                if ended or text[end : end + 1] in (*" \t\n\r,:]}",):  # else a number could go on
                    at = end
                    return found
            more()

    taken("{")
    after = "," if ahead() != "}" else taken("}")
    while after == ",":
        key = value()
        taken(":")
        if key == field and ahead() == "[":
            taken("[")
            after = "," if ahead() != "]" else taken("]")
            while after == ",":
                yield key, value()
                after = taken(",]")
        else:
            yield key, value()
        after = taken(",}")
    if ahead():
        raise ValueError("no JSON object: there is more after it")


def read_report(spark: SparkSession, path: str, field: str, schema: str, folder: str) -> tuple[dict, DataFrame]:
    """What a JSON report holds beside the list ``field``, and the list's rows, however many.

    The driver reads a chunk at a time and hands the rows on as JSON lines in ``folder``, which it shares with the executors.
    """
    head, lines = {}, f"{folder.rstrip('/')}/{field}.jsonl"
    with open_text(lines) as write:
        for key, value in entries(read_chunks(path), field):
            if key == field:
                write(json.dumps(value, ensure_ascii=False) + "\n")
            else:
                head[key] = value
    return head, spark.read.schema(schema).json(lines, mode="FAILFAST")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(index, record) of a manifest: a JSON file, or a folder of Parquet with index and JSON text."""
    if path.endswith("/"):
        return spark.read.parquet(path).select("index", F.parse_json("record").alias("record"))
    return records(read_payload(spark, path)).select("index", "record")


def records(payloads: DataFrame) -> DataFrame:
    """(index, record) of a list or of an object with a list of samples; anything else raises."""
    top = kind(F.col("payload"))
    inner = kind(at(F.col("payload"), "$.samples"))
    rows = F.when(top.startswith("ARRAY"), F.try_variant_get("payload", "$", "array<variant>")).when(inner.startswith("ARRAY"), F.try_variant_get("payload", "$.samples", "array<variant>"))
    rows = F.coalesce(rows, F.raise_error(F.lit(SHAPE)).cast("array<variant>"))
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keep, F.posexplode(rows).alias("index", "record"))


def only_objects(rows: DataFrame) -> DataFrame:
    return rows.where(kind(F.col("record")).startswith("OBJECT"))


def container(payload: Column) -> Column:
    """struct(name, items) of an index: a list, the first key that holds one, or an object's values."""
    listed = [F.when(kind(at(payload, f"$.{k}")).startswith("ARRAY"), F.struct(F.lit(f"payload['{k}']").alias("name"), F.try_variant_get(payload, f"$.{k}", "array<variant>").alias("items"))) for k in CONTAINERS]
    top = kind(payload)
    plain = F.when(top.startswith("ARRAY"), F.struct(F.lit("top-level list").alias("name"), F.try_variant_get(payload, "$", "array<variant>").alias("items")))
    values = F.when(top.startswith("OBJECT"), F.struct(F.lit("top-level dict").alias("name"), F.map_values(F.try_variant_get(payload, "$", "map<string,variant>")).alias("items")))
    return F.coalesce(plain, *listed, values)


def tagged_items(payload: Column) -> Column:
    """array<struct(key, value)> of a tagged index, an object of lists."""
    return F.map_entries(F.try_variant_get(payload, "$", "map<string,variant>"))


def preview(value: Column, most: int = 3) -> Column:
    """The first keys of an object, or items of a list, each with its type; of anything else its own type."""
    entries = F.slice(F.array_sort(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"), ), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), 1, most)
    items = F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, most)
    short = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), short(e["value"]))), ", "), F.lit("}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, short), ", "), F.lit("]"))
    return F.when(kind(value).startswith("OBJECT"), keyed).when(kind(value).startswith("ARRAY"), listed).otherwise(short(value))


def record_id(record: Column) -> Column:
    """The trimmed id, as text: a JSON null is 'None', a missing one empty."""
    raw = at(record, "$.sample_id")
    return F.when(raw.isNull(), "").when(kind(raw) == "VOID", "None").otherwise(F.trim(F.coalesce(F.try_variant_get(raw, "$", "string"), F.to_json(raw))))


def reasons(record: Column, expected=VIEWS) -> Column:
    """Why a record is invalid, in order and without repeats; empty for a valid one. The texts are fixed values, by which results are compared."""
    cams, meta = at(record, "$.metadata.camera_videos"), at(record, "$.metadata")
    paths = F.try_variant_get(cams, "$", "map<string,variant>")
    blank_id = F.when(record_id(record) == "", "sample_id is required and must be non-empty")
    missing = F.array_except(F.array(*[F.lit(v) for v in expected]), F.map_keys(paths))
    empty = []
    for v in expected:
        path = F.try_element_at(paths, F.lit(v))
        blank = (kind(path) == "VOID") | (F.trim(F.try_variant_get(path, "$", "string")) == "")
        empty.append(F.when(F.map_contains_key(paths, v) & blank, f"{v} path is required and must be non-empty"))
    checks = F.array(blank_id, F.when(F.size(missing) > 0, F.concat(F.lit("missing expected camera views: "), F.array_join(missing, ", "))), *empty)
    one = lambda text: F.array(blank_id, F.lit(text))
    found = (
        F.when(~kind(record).startswith("OBJECT"), F.array(F.lit("sample must be an object")))
        .when(meta.isNotNull() & (kind(meta) != "VOID") & ~kind(meta).startswith("OBJECT"), one("metadata must be an object when provided"))
        .when(cams.isNull() | (kind(cams) == "VOID"), one("metadata['camera_videos'] is required"))
        .when(~kind(cams).startswith("OBJECT"), one("metadata['camera_videos'] must be a dict when provided"))
        .otherwise(checks)
    )
    return F.array_distinct(F.filter(found, lambda r: r.isNotNull()))


def inspected(rows: DataFrame, expected=VIEWS) -> DataFrame:
    """(index, sample_id, reasons, valid, record); an id that is missing becomes index_<i>."""
    fallback = F.concat(F.lit("index_"), F.col("index").cast("string"))
    own = F.when(kind(F.col("record")).startswith("OBJECT"), record_id(F.col("record")))
    out = rows.withColumn("sample_id", F.when(F.coalesce(own, F.lit("")) == "", fallback).otherwise(own)).withColumn("reasons", reasons(F.col("record"), expected))
    return out.withColumn("valid", F.size("reasons") == 0)


def inspection(rows: DataFrame, expected=VIEWS) -> DataFrame:
    """One row: counts, whether all is valid, and the invalid records with their reasons."""
    seen = inspected(rows, expected)
    return seen.agg(F.count("*").alias("num_samples"), F.count_if("valid").alias("num_valid"), F.count_if(~F.col("valid")).alias("num_invalid"))


def inspect_file(spark: SparkSession, path: str, name: str = "", expected=VIEWS) -> tuple[dict, DataFrame | None]:
    """The inspection of a manifest file: a report without its list, and the invalid records (None if there are none to read).

    A file that is missing, not JSON or of another shape gives a report with an error.
    """
    report = {"dataset_name": name, "data_file": path, "camera_videos_key": "camera_videos", "expected_camera_views": list(expected), "file_exists": exists(path), "samples_format_valid": False, "num_samples": 0, "num_valid_samples": 0, "num_invalid_samples": 0, "check_paths": False}
    if not report["file_exists"]:
        return report | {"error": f"Data file does not exist: {path}"}, None
    payload = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("payload"))
    top = kind(F.col("payload"))
    fits = top.startswith("ARRAY") | F.coalesce(kind(at(F.col("payload"), "$.samples")).startswith("ARRAY"), F.lit(False))
    found = payload.agg(F.bool_and(F.col("payload").isNotNull()).alias("json"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits")).first()
    if not found.fits:
        return report | {"error": "ValueError: " + (SHAPE if found.json else f"{path} is no JSON")}, None
    rows = records(payload)
    counts = inspection(rows, expected).first()
    return report | {"samples_format_valid": True, "num_samples": counts.num_samples, "num_valid_samples": counts.num_valid, "num_invalid_samples": counts.num_invalid}, invalid_records(rows, expected)


def invalid_records(rows: DataFrame, expected=VIEWS) -> DataFrame:
    return inspected(rows, expected).where(~F.col("valid")).select("index", "sample_id", "reasons")


def text_of(value: Column) -> Column:
    """Null stays null, all else becomes text."""
    return F.when(kind(value) != "VOID", F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def normalized(rows: DataFrame, expected=VIEWS) -> DataFrame:
    """Sample rows of the valid records: trimmed id, paths as text, view maps without null paths, typed objects."""
    valid = inspected(rows, expected).where("valid")
    r = F.col("record")
    cams = F.map_filter(F.transform_values(F.try_variant_get(r, "$.metadata.camera_videos", "map<string,variant>"), lambda k, v: text_of(v)), lambda k, v: v.isNotNull())
    objects = F.filter(F.coalesce(F.try_variant_get(r, "$.objects", "array<variant>"), F.array().cast("array<variant>")), lambda o: F.schema_of_variant(o).startswith("OBJECT"))
    track = F.transform(objects, lambda o: F.struct(
        F.coalesce(F.try_variant_get(o, "$.object_id", "string"), F.lit("")).alias("object_id"), F.coalesce(F.try_variant_get(o, "$.category", "string"), F.lit("")).alias("category"),
        F.coalesce(F.try_variant_get(o, "$.boxes", "array<struct<frame_index int, bbox array<double>>>"), F.array().cast("array<struct<frame_index:int,bbox:array<double>>>")).alias("boxes"),
        F.coalesce(F.try_variant_get(o, "$.attributes", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("attributes")))
    return valid.select("sample_id", text_of(at(r, "$.generated_video")).alias("generated_video"), text_of(at(r, "$.reference_video")).alias("reference_video"), F.coalesce(text_of(at(r, "$.prompt")), F.lit("")).alias("prompt"), track.alias("objects"), at(r, "$.metadata").alias("metadata"), cams.alias("camera_videos"))


def metadata_of(rows: DataFrame, expected=VIEWS) -> DataFrame:
    """(index, sample_id, metadata) of the valid records."""
    return inspected(rows, expected).where("valid").select("index", "sample_id", at(F.col("record"), "$.metadata").alias("metadata"))


def with_metadata(rows: DataFrame, enriched: DataFrame) -> DataFrame:
    """(index, record as JSON text): records with the metadata of ``enriched`` (index, metadata), where there is one."""
    seen = rows.select("index", "record").join(enriched.select("index", F.col("metadata").alias("_m")), "index", "left")
    fields = F.try_variant_get("record", "$", "map<string,variant>")
    new = F.map_concat(F.map_filter(fields, lambda k, v: k != "metadata"), F.create_map(F.lit("metadata"), F.col("_m")))
    return seen.select("index", F.when(F.col("_m").isNotNull(), F.to_json(F.to_variant_object(new))).otherwise(F.to_json("record")).alias("record"))


def view_paths(samples: DataFrame) -> DataFrame:
    """(sample_id, view, path) of normalised samples."""
    return samples.select("sample_id", F.explode("camera_videos").alias("view", "path"))


def require_all_valid(rows: DataFrame, expected=VIEWS) -> DataFrame:
    """Normalised samples; the first invalid record fails the job."""
    seen = inspected(rows, expected)
    ok = F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid sample "), F.col("sample_id"), F.lit(": "), F.array_join("reasons", "; "))).cast("boolean"))
    return normalized(seen.where(ok).select(*rows.columns), expected)
