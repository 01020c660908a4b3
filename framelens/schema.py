"""Names, dimensions and row types that all operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six camera views in their expected order.
VIEWS = ("camera_front", "camera_cross_left", "camera_cross_right", "camera_rear_left", "camera_rear_right", "camera_rear")
#: Neighbouring cameras, with the side of each that overlaps.
CAMERA_PAIRS = (
    ("camera_front", "camera_cross_left", "left", "right"),
    ("camera_front", "camera_cross_right", "right", "left"),
    ("camera_cross_left", "camera_rear_left", "left", "right"),
    ("camera_cross_right", "camera_rear_right", "right", "left"),
    ("camera_rear_left", "camera_rear", "right", "left"),
    ("camera_rear_right", "camera_rear", "left", "right"),
)
TRACK = "object_id string, category string, boxes array<struct<frame_index:int,bbox:array<double>>>, attributes map<string,string>"
TRACKS = TRACK.replace(" string", ":string").replace(" array", ":array").replace(" map", ":map")
SAMPLE = f"sample_id string, generated_video string, reference_video string, prompt string, objects array<struct<{TRACKS}>>, metadata variant"
OUTCOME = "metric string, sample_id string, score double, status string, reason string"


def each_view(df: DataFrame, names=VIEWS) -> DataFrame:
    """Every row once for each view, with view_rank and view; the list is a constant, so nothing is joined."""
    return df.select("*", F.posexplode(F.array(*[F.lit(v) for v in names])).alias("view_rank", "view"))


def camera_pairs(spark: SparkSession) -> DataFrame:
    """(pair, cam_a, cam_b, side_a, side_b): six rows."""
    return F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(CAMERA_PAIRS)], "pair int, cam_a string, cam_b string, side_a string, side_b string"))
