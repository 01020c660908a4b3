"""Instance coherence: adjacent cosine and jitter of object features, object -> view -> sample.

``features``: sample_id, view, object_id, t, feature; a null view is the older form without views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.sequences import nested_mean, sequence_scores


def object_scores(features: DataFrame) -> DataFrame:
    return sequence_scores(features, ["sample_id", "view", "object_id"], ["t"], "feature")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "sample_id", value: str = "score") -> DataFrame:
    """The rows of ``primary`` that have a value, and those of ``fallback`` for keys without one."""
    scored = primary.where(F.col(value).isNotNull())
    return scored.unionByName(fallback.where(F.col(value).isNotNull()).join(scored.select(key), key, "left_anti"))


def sample_scores(features: DataFrame) -> DataFrame:
    scores = object_scores(features)
    views = nested_mean(scores.where("view IS NOT NULL"), ["sample_id", "view", "object_id"])
    older = nested_mean(scores.where("view IS NULL").select("sample_id", "object_id", "score"), ["sample_id", "object_id"])
    return with_fallback(views, older)


def evaluate(samples: DataFrame, features: DataFrame) -> DataFrame:
    out = samples.select("sample_id").join(sample_scores(features), "sample_id", "left")
    return out.select(F.lit("instance_coherence").alias("metric"), "sample_id", "score", F.when(F.col("score").isNotNull(), "success").otherwise("skipped").alias("status"), F.when(F.col("score").isNull(), "no object could be scored").alias("reason"))
