"""Video integrity: six checks over the views of a sample, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.numeric import positive
from framelens.schema import VIEWS, each_view

CHECKS = ("presence", "readability", "frame_count_consistency", "fps_consistency", "duration_consistency", "resolution_consistency")


def grid(samples: DataFrame, inventory: DataFrame, names=VIEWS) -> DataFrame:
    """Every sample with every expected view, and the inventory's row where there is one."""
    return each_view(samples.select("sample_id"), names).join(inventory, ["sample_id", "view"], "left")


def consistent(values: str, expected: int, tolerance: float):
    """All ``expected`` values are positive and deviate from their median by ``tolerance`` of it at most."""
    ok = F.filter(values, positive)
    ordered = F.array_sort(ok)
    half = expected // 2
    median = (F.try_element_at(ordered, F.lit((expected + 1) // 2)) + F.try_element_at(ordered, F.lit(half + 1))) / 2
    return (F.size(ok) == expected) & F.coalesce(F.array_max(F.transform(ok, lambda v: F.abs(v - median) / median)) <= tolerance, F.lit(False))


def sample_checks(samples: DataFrame, inventory: DataFrame, names=VIEWS, tolerance: float | dict[str, float] = 0.05) -> DataFrame:
    """sample_id, one boolean a check, failed_checks (in order), valid.

    ``inventory``: sample_id, view, readable, frame_count, fps, duration, width, height.
    ``tolerance`` is one for all, or by frame_count, fps and duration.
    """
    allowed = lambda c: tolerance.get(c, 0.05) if isinstance(tolerance, dict) else tolerance
    n = len(names)
    value = lambda c: F.collect_list(F.col(c).cast("double"))  # noqa: E731  at most one a view
    size = F.when(positive(F.col("width").cast("double")) & positive(F.col("height").cast("double")), F.struct("width", "height"))
    rows = grid(samples, inventory, names).groupBy("sample_id").agg(
        (F.count_if(F.col("readable").isNotNull()) == n).alias("presence"), (F.count_if("readable") == n).alias("readability"),
        value("frame_count").alias("frame_counts"), value("fps").alias("fpss"), value("duration").alias("durations"),
        ((F.count(size) == n) & (F.min(size) == F.max(size))).alias("resolution_consistency"),
    )
    for check, of in (("frame_count_consistency", "frame_counts"), ("fps_consistency", "fpss"), ("duration_consistency", "durations")):
        rows = rows.withColumn(check, consistent(of, n, allowed(of[:-1])))
    failed = F.filter(F.array(*[F.when(~F.col(c), c) for c in CHECKS]), lambda c: c.isNotNull())
    return rows.select("sample_id", *CHECKS, failed.alias("failed_checks")).withColumn("valid", F.size("failed_checks") == 0)


def summary(checks: DataFrame) -> DataFrame:
    """One row; the metric succeeds as soon as anything was evaluated, even if all fail."""
    out = checks.agg(F.count("*").alias("num_samples"), F.count_if("valid").alias("valid_sample_count"), F.count_if(~F.col("valid")).alias("invalid_sample_count"))
    return out.select("*", F.when(F.col("num_samples") > 0, F.col("valid_sample_count") / F.col("num_samples")).alias("pass_rate"), F.when(F.col("num_samples") > 0, "success").otherwise("skipped").alias("status"))


def evaluate(samples: DataFrame, inventory: DataFrame, names=VIEWS, tolerance: float | dict[str, float] = 0.05) -> DataFrame:
    out = sample_checks(samples, inventory, names, tolerance)
    reason = F.when(~F.col("valid"), F.concat(F.lit("failed checks: "), F.array_join("failed_checks", ", ")))
    return out.select(F.lit("video_integrity").alias("metric"), "sample_id", F.col("valid").cast("double").alias("score"), F.lit("success").alias("status"), reason.alias("reason"))
