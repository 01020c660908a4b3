"""Queries of sinks and sources: written to the shared folder, read again, and held against the SQL of what was written."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.functions import text
from framelens.operators import enrich, outcomes
from framelens.plans import registry, runner
from framelens.queries import data, metrics  # noqa: F401  their queries are written here
from framelens.queries import fixtures as fx
from framelens.queries.base import ORACLE_SQL, QUERIES, query, r6
from framelens.queries.fixtures import SQL
from framelens.sources import files, manifest, sinks
from framelens.streaming.incremental import running_scores
from framelens.sources.registry import build_dataset, load_config, register_datasets


def shared(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where that is unset (one machine) in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    return f"{root.rstrip('/')}/framelens-{uuid.uuid4().hex}"


# Reports: small, written by the driver


@query("SNK1_SNK3", "SELECT r_regionkey AS index, r_name AS sample_id, 'regions' AS dataset_name FROM region")
def snk3(spark, sf):
    path = f"{shared(spark)}/manifest.json"
    sinks.enveloped(fx.table(spark, sf, "region").orderBy("r_regionkey").select(F.col("r_name").alias("sample_id")), {"dataset_name": "regions"}, path)
    payload = manifest.read_payload(spark, path).withColumn("dataset_name", F.try_variant_get("payload", "$.dataset_name", "string"))
    return manifest.records(payload).select("index", manifest.record_id(F.col("record")).alias("sample_id"), "dataset_name")


_CONTEXT = "'real' AS dataset_name, 4 AS data_count, '20240101' AS timestamp"


def _manifest(spark, sf) -> str:
    """A manifest file of a record a customer, in ten shapes, whose name has the context of a run."""
    path = f"{shared(spark)}/real_4_20240101.json"
    rows = fx.manifest_records(spark, sf).orderBy("index").select(F.to_json("record"))
    sinks.write_rows(path, {"version": 1}, "samples", (json.loads(r[0]) for r in rows.toLocalIterator()))
    return path


def _report(spark, path: str, **kinds: str) -> DataFrame:
    """The fields of a report, and its whole as ``payload``."""
    read = manifest.read_payload(spark, path)
    return read.select(*(F.try_variant_get("payload", f"$.{k}", kind).alias(k) for k, kind in kinds.items()), "payload")


@query("SNK8_INS1_detail", f"""{data.SEEN}, n AS (SELECT count(*) AS a, count(*) FILTER (reasons = '') AS v FROM r)
    SELECT 'real' AS dataset_name, true AS file_exists, true AS samples_format_valid, false AS check_paths, a AS num_samples, v AS num_valid_samples, a - v AS num_invalid_samples, sample_id, reasons FROM r, n WHERE reasons <> ''""")
def snk8(spark, sf):
    """The inspection of a manifest file as a report, read again: a row an invalid record."""
    found, invalid = manifest.inspect_file(spark, _manifest(spark, sf), "real")
    path = f"{shared(spark)}/data_inspection.json"
    sinks.write_rows(path, found, "invalid_samples", (r.asDict() for r in invalid.select("sample_id", "reasons").toLocalIterator()))
    counts = {f"num_{x}samples": "long" for x in ("", "valid_", "invalid_")}
    out = _report(spark, path, dataset_name="string", file_exists="boolean", samples_format_valid="boolean", check_paths="boolean", **counts, invalid_samples="array<struct<sample_id string, reasons array<string>>>")
    return out.select(*[c for c in out.columns if c not in ("payload", "invalid_samples")], F.explode("invalid_samples").alias("x")).select("*", "x.sample_id", F.array_join("x.reasons", "; ").alias("reasons")).drop("x")


@query("SNK9", f"""SELECT {_CONTEXT}, count(DISTINCT o_custkey % 500) AS num_samples, CASE o_orderkey % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'semantic' ELSE 'tracks' END AS generator, count(*) FILTER (o_orderkey % 7 <> 0) AS prepared, count(*) FILTER (o_orderkey % 7 = 0) AS failed, round(count(*) FILTER (o_orderkey % 7 <> 0) / count(*), 6) AS coverage_ratio FROM orders GROUP BY o_orderkey % 3
    UNION ALL SELECT {_CONTEXT}, count(DISTINCT o_custkey % 500) AS num_samples, 'failed samples' AS generator, 0 AS prepared, count(DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 500 END) AS failed, 0.0 AS coverage_ratio FROM orders""".replace("count(DISTINCT o_custkey % 500) AS num_samples, CASE", "(SELECT count(DISTINCT o_custkey % 500) FROM orders) AS num_samples, CASE"))
def snk9(spark, sf):
    """The reference report, with the run's context, the generators and the samples that failed."""
    path = f"{shared(spark)}/reference_summary.json"
    patches = data.patches(spark, sf)
    by = {r.generator: r.asDict() for r in enrich.generator_summary(patches).collect()}
    context = spark.range(1).select(text.run_context(F.lit("out/real_4_20240101.json")).alias("c")).first().c.asDict()
    head = {"status": "success"} | context | {"num_samples": patches.select("sample_id").distinct().count(), "generator_summary": by}
    sinks.write_rows(path, head, "failed_samples", (r.asDict(recursive=True) for r in enrich.failed_samples(patches).toLocalIterator()))
    row = "struct<prepared long, failed long, coverage_ratio double>"
    out = _report(spark, path, dataset_name="string", data_count="int", timestamp="string", num_samples="long", generator_summary=f"map<string,{row}>", failed_samples="array<variant>")
    last = F.struct(F.lit("failed samples").alias("key"), F.struct(F.lit(0).cast("long").alias("prepared"), F.size("failed_samples").cast("long").alias("failed"), F.lit(0.0).alias("coverage_ratio")).alias("value"))
    rows = F.array_append(F.map_entries("generator_summary"), last)
    return out.select("dataset_name", "data_count", "timestamp", "num_samples", F.explode(rows).alias("g")).select("dataset_name", "data_count", "timestamp", "num_samples", F.col("g.key").alias("generator"), "g.value.*")


_REPORTED = ("num_samples", "evaluated_count", "skipped_count", "failed_count")
_FIELDS = ("num_samples", "valid_sample_count", "skipped_sample_count", "failed_sample_count")
_SUM = ORACLE_SQL["ACC1_ACC2_RPT1_PRJ8"]
_RUN = {"dataset_name": "real", "data_count": 4, "timestamp": "20240101", "data_file": "real_4_20240101.json"}
_RENAMED = "metric, num_samples, evaluated_count AS valid_sample_count, skipped_count AS skipped_sample_count, failed_count AS failed_sample_count, mean_score, status"


def _metric(name: str):
    value = lambda c, kind: F.try_variant_get("m", f"$.{c}", kind)
    mean = F.try_element_at(F.try_variant_get("m", "$", "map<string,variant>"), F.concat(F.lit("mean_"), name, F.lit("_score")))
    return [*(value(c, "long").alias(c) for c in _FIELDS), (F.round(F.try_variant_get(mean, "$", "double"), 6) + F.lit(0.0)).alias("mean_score"), value("status", "string").alias("status")]


@query("SNK4", f"SELECT {_CONTEXT}, 'real_4_20240101.json' AS data_file, {_RENAMED}, num_samples AS n_outcomes FROM ({_SUM})")
def snk4(spark, sf):
    """The envelope of all metrics, and how many outcomes the table beside it has of each."""
    path = f"{shared(spark)}/metrics.json"
    rows = fx.outcomes(spark, sf)
    sinks.metrics_report(outcomes.metric_summary(rows), rows, path, _RUN)
    out = _report(spark, path, dataset_name="string", data_count="int", timestamp="string", data_file="string", results="map<string,variant>")
    out = out.select(*_RUN, F.explode("results").alias("metric", "m")).select(*_RUN, "metric", *_metric("metric"))
    counted = spark.read.parquet(f"{path}.outcomes").groupBy("metric").agg(F.count("*").alias("n_outcomes"))
    return out.join(counted, "metric")


@query("SNK5", f"SELECT dataset_name, kind, metric, status, sample_id, reason, n FROM (SELECT 'real' AS dataset_name, 'summary' AS kind, metric, status, NULL AS sample_id, NULL AS reason, evaluated_count AS n FROM ({_SUM}) UNION ALL SELECT 'real', 'failed metric', metric, status, NULL, NULL, failed_count FROM ({_SUM}) WHERE status = 'failed' UNION ALL SELECT 'real', 'failed sample', metric, status, sample_id, reason, NULL FROM ({ORACLE_SQL['RPT2_PRJ7']}))")
def snk5(spark, sf):
    """Both summary reports: metrics with their status, those that failed, and the samples that were skipped or failed."""
    folder = shared(spark)
    rows = fx.outcomes(spark, sf)
    sinks.summary_reports(outcomes.metric_summary(rows), outcomes.failed_samples(rows), folder, _RUN)
    body = _report(spark, f"{folder}/summary.json", dataset_name="string", summary="map<string,variant>").select("dataset_name", F.explode("summary").alias("metric", "m"))
    pick = lambda df, kind, n: df.select("dataset_name", F.lit(kind).alias("kind"), "metric", F.try_variant_get("m", "$.status", "string").alias("status"), F.lit(None).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("reason"), F.try_variant_get("m", f"$.{n}", "long").alias("n"))
    metrics_ = pick(body.where("metric <> '_failed_metrics'"), "summary", "valid_sample_count")
    bad = body.where("metric = '_failed_metrics'").select("dataset_name", F.explode(F.try_variant_get("m", "$", "map<string,variant>")).alias("metric", "m"))
    head, samples = manifest.read_report(spark, f"{folder}/failed_samples.json", "failed_samples", "metric string, status string, sample_id string, reason string", f"{folder}/read")
    samples = samples.select(F.lit(head["dataset_name"]).alias("dataset_name"), F.lit("failed sample").alias("kind"), "metric", "status", "sample_id", "reason", F.lit(None).cast("long").alias("n"))
    return metrics_.unionByName(pick(bad, "failed metric", "failed_sample_count")).unionByName(samples)


# Runs


def _tracks(samples: DataFrame, config: dict) -> DataFrame:
    """A generator: two labels a sample, of which every third has only one kind; every seventh fails."""
    n = F.length("sample_id") + F.ascii(F.substring("sample_id", -1, 1))
    labels = F.when(n % 3 == 0, F.lit('["car", "car"]')).otherwise(F.lit('["car", "bus"]'))
    patch = F.create_map(F.lit("instance_tracks"), F.concat(F.lit('{"camera_front": [{"object_id": "1", "identities": '), labels, F.lit("}]}")))
    return samples.select("sample_id", F.lit("tracks").alias("generator"), F.lit(0).alias("rank"), patch.alias("patch"), F.when(n % 7 == 0, "ValueError: no tracks").alias("error"))


@contextlib.contextmanager
def _plugged(kind: dict, name: str, function):
    """A plug-in that is known for the time of a run."""
    registry.register(kind, name, function)
    try:
        yield
    finally:
        del kind[name]


_RUN_SQL = f"""{data.SEEN}, s AS (SELECT sample_id, length(sample_id) + ascii(right(sample_id, 1)) AS n FROM r WHERE reasons = '')"""


@query("RUN1_RUN2_RUN3_UDF2_JN12", f"""{_RUN_SQL} SELECT sample_id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN 0.8 ELSE 0.4 END AS score, CASE WHEN n % 7 = 0 THEN 'skipped' ELSE 'success' END AS status FROM s""")
def run_enriched(spark, sf):
    """A whole run: a generator enriches the manifest, and a metric with a weight of its own evaluates what it wrote."""
    folder = shared(spark)
    config = {"stage": "prepare_reference,evaluate,summarize", "continue_on_error": True, "generators": {"tracks": {}}, "metrics": {"instance_consistency": {"enabled": True, "metric": {"class_weight": 0.8}}, "view_consistency": {}}}
    with _plugged(registry.GENERATORS, "tracks", _tracks):
        runner.run(spark, _manifest(spark, sf), {}, config, folder)
    return spark.read.parquet(f"{folder}/outcomes/instance_consistency").select("sample_id", *r6("score"), "status")


@query("RUN4_UDF3_SNK7_SNK12", "SELECT 'cluster answers' AS what, 1 AS n UNION ALL SELECT 'log lines on stages', 1 UNION ALL SELECT 'folders', 10 UNION ALL SELECT 'failed visualizers', 1 UNION ALL SELECT 'pixels', (SELECT count(*) FROM nation)")
def run_visualized(spark, sf):
    """The visualize stage: two plug-ins, one of which raises; the folders and the log of the run."""
    folder = shared(spark)
    tables = {"n": fx.table(spark, sf, "nation").select("n_nationkey")}
    config = {"stage": "visualize", "visualizers": {"keys": {"enabled": True}, "broken": {"enabled": True}}}
    with _plugged(registry.VISUALIZERS, "keys", lambda s, t, c: t["n"]), _plugged(registry.VISUALIZERS, "broken", lambda s, t, c: t["n"].select("nothing")):
        runner.run(spark, _manifest(spark, sf), tables, config, folder)
    log = spark.read.text(f"{folder}/logs/run.log").where(F.col("value").contains("stages: visualize")).count()
    shown = manifest.read_payload(spark, f"{folder}/visualization_summary.json").select(F.explode(F.try_variant_get("payload", "$", "array<struct<target string, status string>>")).alias("x"))
    rows = [("cluster answers", int(runner.probe(spark)["answers"])), ("log lines on stages", log), ("folders", sum(sinks.exists(f"{folder}/{f}") for f in sinks.LAYOUT)), ("failed visualizers", shown.where("x.status = 'failed'").count()), ("pixels", spark.read.parquet(f"{folder}/visualizations/keys").count())]
    return spark.createDataFrame(rows, "what string, n long")


@query("SRC5_SRC8", f"{data.SEEN} SELECT sample_id FROM r WHERE reasons = ''")
def src58(spark, sf):
    """A dataset that a configuration file names and points to its manifest."""
    path = f"{shared(spark)}/config.json"
    sinks.write_report(path, {"datasets": {"customers": {"data_file": _manifest(spark, sf)}}})
    config = load_config(path)
    register_datasets(config)
    return build_dataset("customers", config["datasets"]["customers"]).valid(spark).select("sample_id")


# Tables and tensors: written in parts by the executors


@query("SNK2", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def snk2(spark, sf):
    folder = shared(spark)
    sinks.write_table(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), folder, by=("o_orderpriority",))
    return spark.read.parquet(folder)


@query("SNK10", ORACLE_SQL["TAG1"])
def snk10(spark, sf):
    folder = shared(spark)
    sinks.write_table(QUERIES["TAG1"](spark, sf), folder, "json")
    return spark.read.schema("tag string, sample_count long").json(folder)


def _written(spark, sf, pixel) -> DataFrame:
    """(path, content): a .npy tensor of eight by eight pixels a label, through the tensor sink."""
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = fx.table(spark, sf, "embeddings").select(F.lit("masks").alias("generator"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("sample_id"), F.lit("v").alias("view"), t.alias("t"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform(F.col("embedding").cast("array<double>"), pixel).alias("values"))
    return sinks.write_tensors(e, shared(spark)).select(F.col("sample_id").alias("path"), F.col("npy").alias("content"))


@query("SNK6_SRC12", f"WITH {SQL["masks"]} SELECT sample_id, t - 1 AS t, 8 AS h, 8 AS w, string_agg(CAST(c AS VARCHAR), '' ORDER BY y, x) AS mask FROM masks GROUP BY sample_id, t")
def snk6(spark, sf):
    masks = _written(spark, sf, lambda v: F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2))
    return files.tensors_of(masks).select(F.col("path").alias("sample_id"), "t", "h", "w", F.array_join("values", "").alias("mask"))


@query("SNK11", "SELECT 's' || vec_id AS name, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 100 ELSE 200 END AS INTEGER) AS value FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)")
def snk11(spark, sf):
    """An image a vector, written as PNG and read again."""
    folder = shared(spark)
    gray = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v < -0.05, 0).when(v < 0.05, 100).otherwise(200))
    images = fx.table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("name"), F.lit(8).alias("h"), F.lit(8).alias("w"), gray.alias("values"))
    sinks.write_table(sinks.encoded_images(images), folder)

    def pixels(batches):
        for part in batches:
            part["values"] = [files.png_pixels(x).ravel().tolist() for x in part["png"]]
            yield part[["name", "values"]]

    read = spark.read.parquet(folder).mapInPandas(pixels, "name string, values array<int>")
    return read.select("name", F.posexplode("values").alias("i", "value")).select("name", F.expr("CAST(i div 8 AS int)").alias("y"), F.expr("i % 8").alias("x"), "value")


@query("SRC13", """SELECT 's' || label AS sample_id, CASE WHEN label % 3 = 0 THEN 0 ELSE count(*) END AS n_frames, CASE WHEN label % 3 <> 0 THEN round(max(list_max(CAST(embedding AS DOUBLE[]))), 6) END AS deepest FROM embeddings GROUP BY label""")
def src13(spark, sf):
    """Depth tensors of which every third is cut short: those give a row without values."""
    whole = F.expr("CAST(substr(path, 2) AS int) % 3 <> 0")
    depth = _written(spark, sf, lambda v: v).withColumn("content", F.when(whole, F.col("content")).otherwise(F.expr("substr(content, 1, 200)")))
    out = files.tensors_of(depth, "double").groupBy(F.col("path").alias("sample_id")).agg(F.count("values").alias("n_frames"), F.max(F.array_max("values")).alias("deepest"))
    return out.select("sample_id", "n_frames", *r6("deepest"))


@query("SRC10", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS frame_index, n_name AS frame FROM nation")
def src10(spark, sf):
    """A text file a region; the decoder takes its lines for frames."""
    folder = shared(spark)
    fx.table(spark, sf, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(folder)
    found = files.frames(spark, folder, bytes.splitlines)
    return found.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey"), "frame_index", F.col("frame").cast("string").alias("frame"))


def _header(content: bytes) -> dict:
    """A probe of files whose first line has four numbers."""
    frames, fps, width, height = (float(x) for x in content.split(b"\n")[0].split())
    return {"frame_count": int(frames), "fps": fps, "width": int(width), "height": int(height)}


@query("SRC9_files", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE round((n_nationkey + 1) / 10.0, 6) END AS duration, n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 0 AS readable, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError' END AS reason FROM nation")
def src9_files(spark, sf):
    """Properties of files by a probe; every fifth has a header that it can't read, every fourth no width."""
    folder, k = shared(spark), F.col("n_nationkey")
    header = F.when(k % 5 == 0, "nothing").otherwise(F.concat_ws(" ", k + 1, F.lit(10), F.when(k % 4 == 0, 0).otherwise(640), F.lit(480)))
    fx.table(spark, sf, "nation").select("n_nationkey", header.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    out = files.video_properties(files.probed(spark, folder, _header, "cv2"))
    return out.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), *r6("duration"), "readable", F.substring_index("reason", ":", 1).alias("reason"))


@query("STREAM_IC1", ORACLE_SQL["IC1"])
def stream(spark, sf):
    """Objects' scores of a stream, whose files hold the earlier and the later frames and arrive one by one."""
    folder, keys = shared(spark), ["sample_id", "view", "object_id"]
    frames = fx.frames(spark, sf)
    middle = frames.agg(F.avg("frame_index")).first()[0]
    for part in (frames.where(F.col("frame_index") < middle), frames.where(F.col("frame_index") >= middle)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    scores = running_scores(rows, keys, "frame_index", "feature")
    write = lambda df, i: df.write.mode("append").parquet(f"{folder}/out")
    scores.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("n_frames", "score"), "n_frames").alias("x")
    return spark.read.parquet(f"{folder}/out").groupBy(*keys).agg(last).select(*keys, "x.n_frames", "x.score").select(*keys, "n_frames", *r6("score"))


# Plug-ins


def _sizes():
    return lambda frames: [[float(len(x)), float(x.count(b" "))] for x in frames]


@query("MDL1_MDL2", "SELECT p_partkey, CAST(strlen(p_name) AS DOUBLE) AS n_bytes, CAST(strlen(p_name) - strlen(replace(p_name, ' ', '')) AS DOUBLE) AS n_spaces FROM part")
def mdl(spark, sf):
    """The surface that takes a model: an encoder loaded once a task and called in batches."""
    frames = fx.table(spark, sf, "part").select("p_partkey", F.encode("p_name", "utf-8").alias("frame"))
    out = registry.encoded(frames, _sizes)
    return out.select("p_partkey", F.col("feature")[0].alias("n_bytes"), F.col("feature")[1].alias("n_spaces"))


def _clip_model():
    return lambda frames: [{"t": i, "h": 1, "w": 1, "depth": [float(len(x))]} for i, x in enumerate(frames)]


@query("MDL3", "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS t, CAST(strlen(p_name) AS DOUBLE) AS depth FROM part")
def mdl3(spark, sf):
    """A model of whole clips: it sees a brand's names in order and gives a map for each."""
    frames = fx.table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("t"), F.encode("p_name", "utf-8").alias("frame"))
    return registry.clip_depths(frames, _clip_model, ["p_brand"]).select("p_brand", "t", F.col("depth")[0].alias("depth"))


def _pair_model():
    return lambda two: [{"mconf": [float(two[0][:1] == two[1][:1]), float(len(two[0]) - len(two[1]))]}]


@query("MDL4", "SELECT CAST(p_partkey AS VARCHAR) AS sample_id, CASE WHEN left(p_name, 1) = left(p_type, 1) THEN 1.0 ELSE 0.0 END AS same, CAST(strlen(p_name) - strlen(p_type) AS DOUBLE) AS longer FROM part")
def mdl4(spark, sf):
    """A model of pairs of frames: it sees both at once."""
    pairs = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.lit("a").alias("cam_a"), F.lit("b").alias("cam_b"), F.lit(0).alias("t"), F.encode("p_name", "utf-8").alias("frame_a"), F.encode("p_type", "utf-8").alias("frame_b"))
    return registry.pair_matches(pairs, _pair_model).select("sample_id", F.col("mconf")[0].alias("same"), F.col("mconf")[1].alias("longer"))


@query("UDF1_FLT3", """WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey % 19 = 0 AS short FROM customer)
    SELECT 'view_consistency' AS metric, count(*) AS num_samples, count(*) FILTER (NOT short) AS evaluated_count, count(*) FILTER (short) AS skipped_count, 0 AS failed_count FROM s""")
def udf1(spark, sf):
    """Metrics by name: of two that are configured the enabled one is built and evaluated."""
    configs = {"view_consistency": {"enabled": True}, "depth_consistency": {}}
    found = runner.evaluate(fx.samples(spark, sf), {"matches": fx.matches(spark, sf)}, configs)
    return outcomes.metric_summary(found).select("metric", *_REPORTED)
