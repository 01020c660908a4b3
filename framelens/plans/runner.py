"""The stages of an evaluation: inspect, prepare references, evaluate, summarize, visualize.

Control is on the driver; every stage is one plan over DataFrames.
"""

from __future__ import annotations

import logging
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import text
from framelens.operators import enrich, outcomes
from framelens.plans.registry import GENERATORS, METRICS, VISUALIZERS, build, enabled
from framelens.schema import OUTCOME, VIEWS
from framelens.sources import manifest, sinks

LOG = logging.getLogger("framelens")
OUTCOMES = ("metric", "sample_id", "score", "status", "reason")
STAGES = ("inspect_data", "prepare_reference", "evaluate", "summarize", "visualize")
DEFAULT_STAGES = {"evaluate": True, "summarize": True}


def stage_switches(configured: dict[str, bool] | None = None, asked: str | None = None) -> dict[str, bool]:
    """Which stages run: those asked for ('all', or names joined by commas), else as configured, else the defaults."""
    if asked:
        names = set(STAGES) if asked.strip() == "all" else {x.strip() for x in asked.split(",") if x.strip()}
        if unknown := names - set(STAGES):
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        return {s: s in names for s in STAGES}
    return {s: bool((configured or {}).get(s, DEFAULT_STAGES.get(s, False))) for s in STAGES}


def overlay(runtime: dict) -> dict:
    """The runtime configuration with its chosen profile's values over it."""
    profile = runtime.get("profile")
    profiles = runtime.get("profiles") or {}
    if profile and profile not in profiles:
        raise ValueError(f"unknown profile {profile!r}")
    return {k: v for k, v in runtime.items() if k != "profiles"} | (profiles.get(profile) or {})


def flat_metric(config: dict) -> dict:
    """A metric's settings: those under metric, then under model, then its own; later ones win."""
    own = {k: v for k, v in config.items() if k not in ("metric", "model")}
    return {**(config.get("metric") or {}), **(config.get("model") or {}), **own}


def spark_settings(runtime: dict) -> dict[str, str]:
    """Spark settings of a runtime profile: how many shards, and how large a batch."""
    out = {}
    if runtime.get("num_shards"):
        out["spark.sql.shuffle.partitions"] = str(runtime["num_shards"])
    if runtime.get("batch_size"):
        out["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(runtime["batch_size"])
    return out


def probe(spark: SparkSession) -> dict:
    """Whether the cluster answers, and with how many cores."""
    sc = spark.sparkContext
    return {"version": sc.version, "master": sc.master, "default_parallelism": sc.defaultParallelism, "answers": spark.range(8).count() == 8}


class _Lines(logging.Handler):
    """Keeps a run's messages, for a log in a folder that Spark's file systems write."""

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []

    def emit(self, record):
        self.lines.append(self.format(record))


def log_to(folder: str) -> logging.Handler:
    """Messages go to the console and to run.log in the folder; in a folder with a scheme ``end_log`` writes it."""
    LOG.setLevel(logging.INFO)
    for old in list(LOG.handlers):
        LOG.removeHandler(old)
        old.close()
    own = _Lines() if sinks.is_remote(folder) else logging.FileHandler(f"{folder}/run.log", encoding="utf-8")
    for handler in (logging.StreamHandler(), own):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOG.addHandler(handler)
    return own


def end_log(handler: logging.Handler, folder: str) -> None:
    if isinstance(handler, _Lines):
        with sinks.open_text(f"{folder}/run.log") as write:
            write("".join(f"{line}\n" for line in handler.lines))


def manifest_to_use(raw: str, enriched: str) -> str:
    """The enriched manifest if there is one, else the raw one."""
    return enriched if sinks.exists(enriched) else raw


def prepare(samples: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Patches of all enabled generators, which run by default, in the order of their configuration."""
    patches = [build(GENERATORS, n)(samples, configs[n]) for n in enabled(configs, default=True)]
    if not patches:
        return samples.sparkSession.createDataFrame([], "sample_id string, generator string, rank int, patch map<string,string>, error string")
    return enrich.guarded(reduce(DataFrame.unionByName, patches))


def evaluate(samples: DataFrame, tables: dict[str, DataFrame], configs: dict[str, dict]) -> DataFrame:
    """Outcome rows of all enabled metrics, one plan; Spark runs them together."""
    names = enabled(configs)
    parts = [build(METRICS, n)(samples, tables, flat_metric(configs[n])) for n in names]
    if not parts:
        raise ValueError("no metric is enabled")
    return reduce(DataFrame.unionByName, parts)


def evaluate_each(samples: DataFrame, tables: dict[str, DataFrame], configs: dict[str, dict], folder: str) -> tuple[DataFrame, dict[str, str]]:
    """Outcomes of every enabled metric, each written on its own, and the errors of those that raise: these leave the others alone."""
    spark, errors, found = samples.sparkSession, {}, []
    names = enabled(configs)
    if not names:
        raise ValueError("no metric is enabled")
    for name in names:
        began = time.monotonic()
        try:
            sinks.write_table(build(METRICS, name)(samples, tables, flat_metric(configs[name])).select(*OUTCOMES), f"{folder}/{name}")
            found.append(spark.read.parquet(f"{folder}/{name}"))
        except Exception as e:  # noqa: BLE001  whatever a metric raises is its result
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        LOG.info("metric %s took %.3f s%s", name, time.monotonic() - began, f" and failed: {errors[name]}" if name in errors else "")
    empty = spark.createDataFrame([], OUTCOME)
    return reduce(DataFrame.unionByName, found, empty), errors


def with_errors(summary: DataFrame, errors: dict[str, str], num_samples: int) -> DataFrame:
    """The summary of metrics, and a failed row for each that raised."""
    spark = summary.sparkSession
    rows = spark.createDataFrame([(m, num_samples, 0, 0, 0, None, "failed", e) for m, e in errors.items()], "metric string, num_samples long, evaluated_count long, skipped_count long, failed_count long, mean_score double, status string, reason string")
    return summary.withColumn("reason", F.lit(None).cast("string")).unionByName(rows)


def visualize(samples: DataFrame, tables: dict[str, DataFrame], configs: dict[str, dict], folder: str) -> list[dict]:
    """Writes the pixels of every enabled visualizer, and gives the status of each: success, skipped without its tables, or failed."""
    out = []
    for name in enabled(configs):
        try:
            made = build(VISUALIZERS, name)(samples, tables, configs[name] or {})
            sinks.write_table(made, f"{folder}/{name}")
            out.append({"target": name, "status": "success", "reason": None})
        except KeyError as e:
            out.append({"target": name, "status": "skipped", "reason": f"no table {e}"})
        except Exception as e:  # noqa: BLE001
            out.append({"target": name, "status": "failed", "reason": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"})
    return out


def run(spark: SparkSession, manifest_path: str, tables: dict[str, DataFrame], config: dict, output: str) -> str:
    """Runs the stages that are on, writes the reports, and gives the overall status.

    ``config``: stages or stage, profile and profiles with runtime settings, metrics, generators with
    continue_on_error, visualizers, dataset_name and expected_camera_views.
    """
    stages = stage_switches(config.get("stages"), config.get("stage"))
    sinks.make_layout(output)
    log = log_to(f"{output}/logs")
    runtime = overlay(config).get("runtime") or {}
    before = {k: spark.conf.get(k, None) for k in spark_settings(runtime)}
    for k, v in spark_settings(runtime).items():
        spark.conf.set(k, v)
    try:
        return _run(spark, manifest_path, tables, config, output.rstrip("/"), stages)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        end_log(log, f"{output}/logs")


def _run(spark, manifest_path, tables, config, output, stages) -> str:
    LOG.info("stages: %s", ", ".join(s for s, on in stages.items() if on))
    views = tuple(config.get("expected_camera_views") or VIEWS)
    named = spark.range(1).select(text.run_context(F.lit(manifest_path)).alias("c")).first().c.asDict()
    context = named | {"dataset_name": config.get("dataset_name") or named["dataset_name"], "data_file": manifest_path, "output_dir": output}
    done: list[dict] = []
    if stages["inspect_data"]:
        report, invalid = manifest.inspect_file(spark, manifest_path, context["dataset_name"] or "", views)
        rows = [] if invalid is None else (r.asDict() for r in invalid.select("sample_id", "reasons").toLocalIterator())
        sinks.write_rows(f"{output}/data_inspection.json", report, "invalid_samples", rows)
        done.append({"stage": "inspect_data", "status": "failed" if report.get("error") else "success"})
    if stages["prepare_reference"]:
        samples = manifest.normalized(manifest.read_records(spark, manifest_path), views)
        patches = prepare(samples, config.get("generators") or {})
        sinks.write_table(patches, f"{output}/references/patches")
        patches = spark.read.schema(patches.schema).parquet(f"{output}/references/patches")
        keep_on = bool(config.get("continue_on_error", False))
        first = None if keep_on else patches.where("error IS NOT NULL").orderBy("sample_id", "rank").first()
        if first:
            raise RuntimeError(f"Reference generation failed for sample={first.sample_id}, generator={first.generator}: {first.error}")
        records = manifest.read_records(spark, manifest_path)
        sinks.write_table(manifest.with_metadata(records, enrich.enriched_metadata(manifest.metadata_of(records, views), patches)), f"{output}/enriched_data")
        failed, total = enrich.failed_samples(patches), samples.count()
        by_generator = {r.generator: {"prepared": r.prepared, "failed": r.failed, "coverage_ratio": round(r.prepared / total, 6) if total else 0.0} for r in enrich.generator_summary(patches).collect()}
        head = {"status": "success"} | context | {"num_samples": total, "num_generators": len(by_generator), "enriched_data_path": f"{output}/enriched_data", "reference_output_dir": f"{output}/references", "generator_summary": by_generator, "failed_sample_count": failed.count(), "continue_on_error": keep_on}
        sinks.write_rows(f"{output}/reference_summary.json", head, "failed_samples", (r.asDict(recursive=True) for r in failed.orderBy("sample_id").toLocalIterator()))
        done.append({"stage": "prepare_reference", "status": "success"})
    used = manifest_to_use(manifest_path, f"{output}/enriched_data/")
    samples = manifest.normalized(manifest.read_records(spark, used), views)
    if stages["evaluate"]:
        total = samples.count()
        if not total:
            raise ValueError("No valid samples were found for evaluation.")
        found, errors = evaluate_each(samples, tables, config.get("metrics") or {}, f"{output}/outcomes")
        summary = with_errors(outcomes.metric_summary(found), errors, total)
        context |= {"data_file": used, "num_samples": total}
        sinks.metrics_report(summary, found, f"{output}/metrics.json", {k: v for k, v in context.items() if k != "output_dir"})
        if stages["summarize"]:
            sinks.summary_reports(summary, outcomes.failed_samples(found), output, context)
        done += [{"stage": r.metric, "status": r.status} for r in summary.collect()]
    if stages["visualize"]:
        shown = visualize(samples, tables, config.get("visualizers") or {}, f"{output}/visualizations")
        sinks.write_report(f"{output}/visualization_summary.json", shown)
        done += [{"stage": f"visualize {x['target']}", "status": x["status"]} for x in shown]
    status = outcomes.overall_status(spark.createDataFrame([(x["status"],) for x in done], "status string")).first()[0]
    LOG.info("status: %s", status)
    return status
