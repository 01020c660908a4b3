"""Temporal consistency of views: adjacent cosine and jitter, averaged over the views of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.sequences import sequence_scores
from framelens.schema import VIEWS


def view_scores(features: DataFrame) -> DataFrame:
    """``features``: sample_id, view, frame_index, feature.  A view with a value that isn't finite scores 0."""
    return sequence_scores(features, ["sample_id", "view"], ["frame_index"], "feature", strict=False)


def evaluate(samples: DataFrame, features: DataFrame, expected=VIEWS) -> DataFrame:
    """Outcome rows: a sample without some expected view is skipped, as is one of which no view scores."""
    need = F.array(*[F.lit(v) for v in expected])
    per_sample = view_scores(features).groupBy("sample_id").agg(F.collect_set("view").alias("have"), F.avg("score").alias("score"))
    out = samples.select("sample_id").join(per_sample, "sample_id", "left")
    missing = F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing expected camera views: "), F.array_join(missing, ", "))).when(F.col("score").isNull(), "no view could be scored")
    return out.select(F.lit("temporal_consistency").alias("metric"), "sample_id", F.when(reason.isNull(), F.col("score")).alias("score"), F.when(reason.isNull(), "success").otherwise("skipped").alias("status"), reason.alias("reason"))
