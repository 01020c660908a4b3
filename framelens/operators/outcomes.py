"""Accounting of metric outcomes and the reports made of them.

Outcome rows: metric, sample_id, score, status (success, skipped, failed), reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_summary(outcomes: DataFrame) -> DataFrame:
    """metric, counts, mean_score, status: a mean makes success, else any failure failed, else skipped."""
    ok = (F.col("status") == "success") & F.col("score").isNotNull() & ~F.isnan("score")
    out = outcomes.groupBy("metric").agg(
        F.count("*").alias("num_samples"), F.count_if(ok).alias("evaluated_count"), F.count_if((F.col("status") == "skipped") | ((F.col("status") == "success") & ~ok)).alias("skipped_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"), F.avg(F.when(ok, F.col("score"))).alias("mean_score"),
    )
    return out.withColumn("status", F.when(F.col("mean_score").isNotNull(), "success").when(F.col("failed_count") > 0, "failed").otherwise("skipped"))


def failed_samples(outcomes: DataFrame) -> DataFrame:
    """metric, status, sample_id, reason of what was skipped or failed."""
    return outcomes.where(F.col("status").isin("failed", "skipped")).select("metric", "status", "sample_id", "reason")


def failed_metrics(summary: DataFrame) -> DataFrame:
    return summary.where("status = 'failed'").select("metric")


def overall_status(summary: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """One row: failed if any metric or stage failed, else success."""
    rows = summary.select("status") if stages is None else summary.select("status").unionByName(stages.select("status"))
    return rows.agg(F.when(F.coalesce(F.max((F.col("status") == "failed").cast("int")), F.lit(0)) == 1, "failed").otherwise("success").alias("status"))


def target_status(targets: DataFrame, keys=("target",)) -> DataFrame:
    """failed before partial (given, or success with skipped) before success before skipped."""
    s = F.collect_set(F.coalesce("status", F.lit("skipped")))
    out = targets.groupBy(*keys).agg(s.alias("s"))
    has = lambda x: F.array_contains("s", x)
    return out.select(*keys, F.when(has("failed"), "failed").when((has("success") & has("skipped")) | has("partial"), "partial").when(has("success"), "success").otherwise("skipped").alias("status"))
