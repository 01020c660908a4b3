"""Re-readings of the driver's tables as sequences, masks, inventories, tracks, paths and tags.

``SQL`` has the same relations for the SQL side, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.schema import CAMERA_PAIRS, VIEWS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEW_CASE = _case("v", VIEWS)
ALIASES = ("cam-front", "Cross Left", "right_front", "back-left", "REAR.right", "back", "front_tele", "roof")
RECORD = """CASE c_custkey % 10
    WHEN 1 THEN '[1, 2]'
    WHEN 2 THEN '{"sample_id": "  ", "metadata": {"camera_videos": {ALL}}}'
    WHEN 3 THEN '{"sample_id": "s' || {K} || '", "metadata": [1]}'
    WHEN 4 THEN '{"sample_id": "s' || {K} || '", "metadata": null}'
    WHEN 5 THEN '{"sample_id": "s' || {K} || '", "metadata": {"camera_videos": null}}'
    WHEN 6 THEN '{"metadata": {"camera_videos": ["a"]}}'
    WHEN 7 THEN '{"sample_id": ' || {K} || ', "metadata": {"camera_videos": {"camera_cross_left": "l", "camera_cross_right": "r", "camera_rear_left": "a", "camera_rear_right": "b"}}}'
    WHEN 8 THEN '{"sample_id": "s' || {K} || '", "metadata": {"camera_videos": {"camera_front": null, "camera_cross_left": " ", "camera_cross_right": "r", "camera_rear_left": "a", "camera_rear_right": "b", "camera_rear": "c"}}}'
    WHEN 9 THEN '{"sample_id": null, "generated_video": 7, "objects": [{"object_id": "o1", "category": "car"}, 3], "metadata": {"camera_videos": {"camera_front": "f", "camera_cross_left": "l", "camera_cross_right": "r", "camera_rear_left": "a", "camera_rear_right": "b", "camera_rear": "c", "extra": null}}}'
    ELSE '{"sample_id": " s' || {K} || ' ", "generated_video": "g' || {K} || '", "metadata": {"camera_videos": {ALL}}}' END""".replace("{ALL}", "{" + ", ".join(f'"{v}": "{v}.mp4"' for v in VIEWS) + "}")


def frames(spark, sf):
    """sample_id, view, object_id, frame_index, feature: embeddings by label, dealt to two views of two objects."""
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("s"), (F.col("label") % 5).cast("string")).alias("sample_id"), F.concat(F.lit("v"), F.expr("label div 5").cast("string")).alias("view"), (F.col("vec_id") % 3).cast("string").alias("object_id"), F.col("vec_id").alias("frame_index"), F.col("embedding").cast("array<double>").alias("feature"))


def clips(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("feature"))


def clips_with_gaps(spark, sf):
    """Every fourth label has values that aren't finite in every fifth frame."""
    gap = F.when(F.col("vec_id") % 2 == 0, float("nan")).otherwise(float("inf"))
    broken = (F.col("label") % 4 == 3) & (F.col("vec_id") % 5 == 0)
    return clips(spark, sf).withColumn("feature", F.when(broken, F.transform("feature", lambda x, i: F.when(i == 0, gap).otherwise(x))).otherwise(F.col("feature")))


def masks(spark, sf):
    """sample_id, view, t, y, x, class_id: eight by eight pixels of three classes."""
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = table(spark, sf, "embeddings").select("label", t.alias("t"), "embedding").select("label", "t", F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return e.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("sample_id"), F.lit("v").alias("view"), "t", F.expr("i div 8").alias("y"), F.expr("i % 8").alias("x"), F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2).alias("class_id"))


def packed_masks(spark, sf):
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    klass = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(v < -0.05, 0).when(v < 0.05, 1).otherwise(2))
    return table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("sample_id"), F.lit("v").alias("view"), t.alias("t"), F.lit(8).alias("h"), F.lit(8).alias("w"), klass.alias("mask"), F.lit(3).alias("num_classes"))


def samples(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"))


def inventory(spark, sf):
    """Six views of every customer; every 13th has no rear view, every 17th an unreadable front."""
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v"))
    c = c.where("NOT (c_custkey % 13 = 0 AND v = 5)")
    return c.select(
        F.col("c_custkey").cast("string").alias("sample_id"), F.expr(VIEW_CASE).alias("view"), (~((F.col("c_custkey") % 17 == 0) & (F.col("v") == 0))).alias("readable"),
        (100 + (F.col("c_custkey") * 7 + F.col("v") * F.col("v") * 3) % 9).alias("frame_count"), F.lit(10.0).alias("fps"), ((100 + (F.col("c_custkey") * 7 + F.col("v") * F.col("v") * 3) % 9) / 10.0).alias("duration"),
        F.when((F.col("c_custkey") % 11 == 0) & (F.col("v") == 3), 1280).otherwise(1920).alias("width"), F.lit(1080).alias("height"),
    )


def boxes(spark, sf):
    """sample_id, view, object_id, frame_index, position, bbox: events as boxes of their users."""
    e = table(spark, sf, "events")
    x, y = F.col("event_id") * 37 % 640, F.col("event_id") * 53 % 480
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("sample_id"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("view"), F.col("user_id").cast("string").alias("object_id"), F.col("event_id").alias("frame_index"), F.lit(0).alias("position"), F.array(x.cast("double"), y.cast("double"), (x + 20 + F.col("event_id") * 11 % 50).cast("double"), (y + 20 + F.col("event_id") * 17 % 50).cast("double")).alias("bbox"))


def labelled(spark, sf):
    """sample_id, view, object_id, event_id, label, confidence."""
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("sample_id"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("view"), F.col("user_id").cast("string").alias("object_id"), "event_id", F.col("event_type").alias("label"), (F.col("value") / 100).alias("confidence"))


def paths(spark, sf):
    """key, path: part types, an alias of a view, and part names."""
    alias = F.expr(_case("p_partkey % 8", ALIASES))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat("p_type", F.lit("/"), alias, F.lit("/"), "p_name").alias("path"))


def matches(spark, sf):
    """sample_id, cam_a, cam_b, t, mconf: n equal confidences; every 19th customer has no last pair."""
    c = table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).where("NOT (c_custkey % 19 = 0 AND p = 5)").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    n = (F.col("c_custkey") * 5 + F.col("t") * 11 + F.col("p") * 3) % 70
    mean = ((F.col("c_custkey") * 13 + F.col("t") * 7 + F.col("p")) % 100) / 100.0
    return c.select(F.col("c_custkey").cast("string").alias("sample_id"), F.expr(_case("p", [p[0] for p in CAMERA_PAIRS])).alias("cam_a"), F.expr(_case("p", [p[1] for p in CAMERA_PAIRS])).alias("cam_b"), "t", F.array_repeat(mean, n.cast("int")).alias("mconf"))


def tagged(spark, sf):
    """position, tag, video, hdmap: events by type, with blank videos and items without any key."""
    e = table(spark, sf, "events")
    video = F.when(F.col("event_id") % 29 == 0, None).when(F.col("event_id") % 31 == 0, "  ").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit(" ")))
    return e.select(F.col("event_id").alias("position"), F.col("event_type").alias("tag"), video.alias("video"), F.when(F.col("event_id") % 29 != 0, F.col("props")).alias("hdmap"))


def manifest_records(spark, sf):
    """index, record: one JSON record a customer, in ten shapes."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("index"), F.parse_json(F.expr(RECORD.replace("{K}", "CAST(c_custkey AS string)"))).alias("record"))


def outcomes(spark, sf):
    """metric, sample_id, score, status, reason: order priorities as metrics."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("skipped")).when(F.col("o_orderkey") % 7 == 0, "skipped").when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("success")
    out = o.select(F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").cast("string").alias("sample_id"), status.alias("status"), (F.col("o_totalprice") % 1).alias("p"))
    return out.select("metric", "sample_id", F.when(F.col("status") == "success", F.col("p")).alias("score"), "status", F.when(F.col("status") != "success", F.concat(F.lit("was "), F.col("status"))).alias("reason"))


SQL = {
    "frames": "frames AS (SELECT 's' || (label % 5) AS sample_id, 'v' || (label // 5) AS view, CAST(vec_id % 3 AS VARCHAR) AS object_id, vec_id AS frame_index, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)",
    "masks": "e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), px AS (SELECT 's' || label AS sample_id, t, unnest(range(0, 64)) AS i, unnest(f) AS v FROM e), masks AS (SELECT sample_id, 'v' AS view, t, i // 8 AS y, i % 8 AS x, CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END AS c FROM px)",
    "inventory": f"inv AS (SELECT c_custkey, v, {VIEW_CASE} AS view, NOT (c_custkey % 17 = 0 AND v = 0) AS readable, 100 + (c_custkey * 7 + v * v * 3) % 9 AS frame_count, CASE WHEN c_custkey % 11 = 0 AND v = 3 THEN 1280 ELSE 1920 END AS width FROM customer, (SELECT unnest(range(0, 6)) AS v) WHERE NOT (c_custkey % 13 = 0 AND v = 5))",
    "boxes": "b AS (SELECT 's' || (user_id % 7) AS sample_id, 'v' || (user_id % 2) AS view, CAST(user_id AS VARCHAR) AS object_id, event_id AS fr, CAST(event_id * 37 % 640 AS DOUBLE) AS x, CAST(event_id * 53 % 480 AS DOUBLE) AS y, CAST(20 + event_id * 11 % 50 AS DOUBLE) AS w, CAST(20 + event_id * 17 % 50 AS DOUBLE) AS h FROM events)",
    "labelled": "l AS (SELECT 's' || (user_id % 7) AS sample_id, 'v' || (user_id % 2) AS view, CAST(user_id AS VARCHAR) AS object_id, event_type AS label, value / 100 AS conf FROM events)",
    "paths": f"paths AS (SELECT p_partkey AS key, p_type || '/' || {_case('p_partkey % 8', ALIASES)} || '/' || p_name AS path FROM part)",
    "matches": f"m AS (SELECT c_custkey, p, t, (c_custkey * 5 + t * 11 + p * 3) % 70 AS n, ((c_custkey * 13 + t * 7 + p) % 100) / 100.0::DOUBLE AS conf, {_case('p', [p[0] for p in CAMERA_PAIRS])} AS cam_a, {_case('p', [p[1] for p in CAMERA_PAIRS])} AS cam_b FROM customer, (SELECT unnest(range(0, 6)) AS p), (SELECT unnest(range(0, 4)) AS t) WHERE NOT (c_custkey % 19 = 0 AND p = 5))",
    "tagged": "tg AS (SELECT event_id AS position, event_type AS tag, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN '  ' ELSE ' u' || user_id || ' ' END AS video, CASE WHEN event_id % 29 <> 0 THEN props END AS hdmap FROM events)",
    "outcomes": "st AS (SELECT o_orderpriority AS metric, CAST(o_orderkey AS VARCHAR) AS sample_id, o_totalprice % 1 AS p, CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'skipped' END WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'success' END AS status FROM orders), oc AS (SELECT metric, sample_id, CASE WHEN status = 'success' THEN p END AS score, status, CASE WHEN status <> 'success' THEN 'was ' || status END AS reason FROM st)",
}
