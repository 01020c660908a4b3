"""Queries of the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions.numeric import clamp01, safe_div
from framelens.operators import coherence, depth, facts, instances, integrity, outcomes, semantic, sequences, temporal, views
from framelens.plans import visual
from framelens.queries import fixtures as fx
from framelens.queries.base import query, r6
from framelens.queries.fixtures import SQL

# Sequences: terms of every clip, guarded so that a clamp never sees a null.
_UNIT = "list_transform(f, lambda x: x / greatest(sqrt(list_dot_product(f, f)), 1e-8))"


def _terms(source: str, keys: str, order: str) -> str:
    return f"""u AS (SELECT {keys}, {order}, {_UNIT} AS u FROM {source}),
        p AS (SELECT *, lag(u, 1) OVER w AS p, lag(u, 2) OVER w AS q FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
        v AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(greatest(list_dot_product(u, p), 0.0), 1.0) END AS c, CASE WHEN p IS NOT NULL THEN list_distance(u, p) END AS vel,
                 CASE WHEN q IS NOT NULL THEN list_distance(list_transform(range(1, len(u) + 1), lambda i: u[i] + q[i]), list_transform(p, lambda x: 2 * x)) END AS acc FROM p),
        j AS (SELECT *, acc / (0.5 * (vel + lag(vel) OVER (PARTITION BY {keys} ORDER BY {order})) + 1e-8) AS jit FROM v),
        s AS (SELECT {keys}, count(*) AS n_frames, avg(c) AS acm, coalesce(avg(jit), 0.0) AS tji FROM j GROUP BY {keys}),
        sc AS (SELECT *, CASE WHEN n_frames >= 2 THEN least(greatest(acm / (1 + tji), 0.0), 1.0) END AS score FROM s)"""


_CLIPS = "cl AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"


# what isn't finite makes all of a clip's terms 0
_GAPS = f"{_CLIPS}, {_terms('cl', 'label', 'vec_id')}, gp AS (SELECT label, n_frames >= 2 AND label % 4 = 3 AND bool_or(vec_id % 5 = 0) AS gap, any_value(n_frames) AS n_frames, any_value(acm) AS acm, any_value(tji) AS tji, any_value(score) AS score FROM sc JOIN (SELECT label AS l, vec_id FROM cl) ON l = label GROUP BY label, sc.n_frames)"


def _clip_scores(spark, sf):
    return sequences.sequence_scores(fx.clips_with_gaps(spark, sf), ["label"], ["vec_id"], "feature", strict=False)


@query("TC1", f"WITH {_GAPS} SELECT label, CASE WHEN gap THEN 0.0 ELSE round(acm, 6) END AS acm FROM gp")
def tc1(spark, sf):
    return _clip_scores(spark, sf).select("label", *r6("acm"))


@query("TC2", f"WITH {_GAPS} SELECT label, CASE WHEN gap THEN 0.0 ELSE round(tji, 6) END AS tji FROM gp")
def tc2(spark, sf):
    return _clip_scores(spark, sf).select("label", *r6("tji"))


@query("TC3", f"WITH {_GAPS} SELECT label, n_frames, CASE WHEN gap THEN 0.0 ELSE round(score, 6) END AS score FROM gp")
def tc3(spark, sf):
    return _clip_scores(spark, sf).select("label", "n_frames", *r6("score"))


@query("TC_outcomes", f"""WITH {SQL['frames']}, {_terms('frames', 'sample_id, view', 'frame_index')},
    a AS (SELECT sample_id, avg(score) AS score, count(*) FILTER (view = 'v0') AS v0, count(*) FILTER (view = 'v2') AS v2 FROM sc GROUP BY sample_id),
    x AS (SELECT s.sample_id, a.score, concat_ws(', ', CASE WHEN coalesce(v0, 0) = 0 THEN 'v0' END, 'v2') AS miss FROM (SELECT DISTINCT 's' || (c_custkey % 8) AS sample_id FROM customer) s LEFT JOIN a USING (sample_id))
    SELECT 'temporal_consistency' AS metric, sample_id, CAST(NULL AS DOUBLE) AS score, 'skipped' AS status, 'missing expected camera views: ' || miss AS reason FROM x""")
def tc_outcomes(spark, sf):
    """A view that no sample has is expected, so every sample is skipped, with what it lacks."""
    samples = fx.table(spark, sf, "customer").select(F.concat(F.lit("s"), (F.col("c_custkey") % 8).cast("string")).alias("sample_id")).distinct()
    return temporal.evaluate(samples, fx.frames(spark, sf), ("v0", "v2"))


@query("AGG4", f"""WITH {SQL['frames']}, {_terms('frames', 'sample_id, view, object_id', 'frame_index')},
    a AS (SELECT sample_id, view, avg(score) AS s FROM sc GROUP BY ALL), b AS (SELECT sample_id, avg(s) AS s FROM a GROUP BY ALL)
    SELECT round(avg(s), 6) AS score FROM b""")
def agg4(spark, sf):
    return sequences.nested_mean(coherence.object_scores(fx.frames(spark, sf).withColumnRenamed("frame_index", "t")), ["sample_id", "view", "object_id"]).agg(F.avg("score").alias("score")).select(*r6("score"))


@query("IC1", f"WITH {SQL['frames']}, {_terms('frames', 'sample_id, view, object_id', 'frame_index')} SELECT sample_id, view, object_id, n_frames, round(score, 6) AS score FROM sc")
def ic1(spark, sf):
    return coherence.object_scores(fx.frames(spark, sf).withColumnRenamed("frame_index", "t")).select("sample_id", "view", "object_id", "n_frames", *r6("score"))


@query("IC2_JN13", f"""WITH {SQL['frames']}, {_terms('frames', 'sample_id, view, object_id', 'frame_index')},
    a AS (SELECT sample_id, view, avg(score) AS s FROM sc GROUP BY ALL) SELECT sample_id, round(avg(s), 6) AS score FROM a GROUP BY sample_id
    UNION ALL SELECT 'old' AS sample_id, round(avg(score), 6) AS score FROM sc WHERE sample_id = 's0' AND view = 'v0'""")
def ic2(spark, sf):
    """The rows of one view are given once more as a sample of the older form, without views."""
    f = fx.frames(spark, sf).withColumnRenamed("frame_index", "t")
    old = f.where("sample_id = 's0' AND view = 'v0'").withColumn("sample_id", F.lit("old")).withColumn("view", F.lit(None).cast("string"))
    return coherence.sample_scores(f.unionByName(old)).select("sample_id", *r6("score"))


@query("WIN1_WIN2_WIN3", f"""WITH {_CLIPS}, {_terms('cl', 'label', 'vec_id')}
, l AS (SELECT label, list_distance(f, lag(f) OVER (PARTITION BY label ORDER BY vec_id)) AS d FROM cl), d AS (SELECT label, avg(d) AS l2 FROM l GROUP BY label)
    SELECT label, n_frames - 1 AS pairs, round(acm, 6) AS acm, round(tji, 6) AS tji, round(l2, 6) AS l2 FROM sc JOIN d USING (label)""")
def win123(spark, sf):
    """Neighbours, and neighbours of these, by the operators that use them."""
    c = fx.clips(spark, sf)
    scored = sequences.sequence_scores(c, ["label"], ["vec_id"], "feature")
    return scored.join(sequences.adjacent_distance(c, ["label"], ["vec_id"], "feature"), "label").select("label", (F.col("n_frames") - 1).alias("pairs"), *r6("acm", "tji", "l2"))


@query("SRC11", """SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 3 = 0) WHERE n <= 4""")
def src11(spark, sf):
    return sequences.strided(fx.clips(spark, sf), ["label"], "vec_id", 3, 4).select("label", "vec_id")


@query("DP2_DP3", f"""WITH {_CLIPS}, d AS (SELECT label, f, lag(f) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM cl), a AS (SELECT label, avg(CASE WHEN p IS NOT NULL THEN list_distance(f, p) END) AS l2 FROM d GROUP BY label)
    SELECT CAST(label AS VARCHAR) AS sample_id, round(l2, 6) AS l2, round(CASE WHEN l2 IS NOT NULL THEN least(greatest(exp(-l2), 0.0), 1.0) END, 6) AS score FROM a""")
def dp23(spark, sf):
    e = fx.clips(spark, sf).select(F.col("label").cast("string").alias("sample_id"), F.lit("v").alias("view"), F.col("vec_id").alias("t"), "feature")
    return depth.clip_scores(e).select("sample_id", *r6("l2", "score"))


_PIX = "d0 AS (SELECT label, vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), dp AS (SELECT label, vec_id, i // 8 AS y, i % 8 AS x, CASE WHEN (vec_id + i) % 97 = 0 THEN 'NaN'::DOUBLE ELSE v END AS depth FROM d0)"


def _depth_pixels(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("sample_id"), F.lit("v").alias("view"), F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "v"))
    return e.select("sample_id", "view", "t", F.expr("i div 8").alias("y"), F.expr("i % 8").alias("x"), F.when((F.col("t") + F.col("i")) % 97 == 0, float("nan")).otherwise(F.col("v").cast("double")).alias("depth"))


@query("DP1_WIN5", f"""WITH {_PIX}, z AS (SELECT *, CASE WHEN isfinite(depth) THEN depth ELSE 0.0 END AS d FROM dp), w AS (SELECT *, min(d) OVER (PARTITION BY label) AS lo, max(d) OVER (PARTITION BY label) AS hi FROM z)
    SELECT CAST(label AS VARCHAR) AS sample_id, vec_id AS t, y, x, CAST(CASE WHEN hi > lo THEN floor((d - lo) / (hi - lo) * 255) ELSE 0 END AS INTEGER) AS gray FROM w""")
def dp1(spark, sf):
    return depth.rendered(_depth_pixels(spark, sf)).select("sample_id", "t", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "gray")


@query("VIS1", f"""WITH {_PIX}, f AS (SELECT * FROM dp QUALIFY vec_id = min(vec_id) OVER (PARTITION BY label)), z AS (SELECT *, CASE WHEN isfinite(depth) THEN depth END AS d FROM f), w AS (SELECT *, min(d) OVER (PARTITION BY label) AS lo, max(d) OVER (PARTITION BY label) AS hi FROM z)
    SELECT CAST(label AS VARCHAR) AS sample_id, y, x, CAST(coalesce(CASE WHEN hi > lo THEN floor((d - lo) / (hi - lo) * 255) END, 0) AS INTEGER) AS gray FROM w""")
def vis1(spark, sf):
    return visual.first_frame_gray(_depth_pixels(spark, sf)).select("sample_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "gray")


@query("JN11", """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, coalesce(m, v) AS score, CASE WHEN m IS NOT NULL THEN 'depth_map' WHEN v IS NOT NULL THEN 'video' END AS source
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.25::DOUBLE END AS m, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS v FROM customer) WHERE c_custkey % 3 = 0 OR c_custkey % 5 <> 0""")
def jn11(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.lit("v").alias("view"), "c_custkey")
    maps = c.where("c_custkey % 3 = 0").select("sample_id", "view", F.lit(0.25).alias("score"))
    videos = c.where("c_custkey % 5 <> 0").select("sample_id", "view", F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("score"))
    return depth.map_else_video(maps, videos).select("sample_id", "score", "source")


# Integrity

_CHECKS = f"""WITH {SQL['inventory']},
    a AS (SELECT c_custkey, count(v) = 6 AS presence, count(*) FILTER (readable) = 6 AS readability, count(v) AS n, median(frame_count) AS md, max(frame_count) AS mx, min(frame_count) AS mn, count(DISTINCT width) = 1 AND count(v) = 6 AS res FROM customer LEFT JOIN inv USING (c_custkey) GROUP BY c_custkey),
    k AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, presence, readability, coalesce(n = 6 AND greatest(mx - md, md - mn) / md <= 0.05, false) AS fc, n = 6 AS fps, coalesce(n = 6 AND greatest(mx - md, md - mn) / md <= 0.05, false) AS du, res FROM a),
    f AS (SELECT *, concat_ws(',', CASE WHEN NOT presence THEN 'presence' END, CASE WHEN NOT readability THEN 'readability' END, CASE WHEN NOT fc THEN 'frame_count_consistency' END, CASE WHEN NOT fps THEN 'fps_consistency' END, CASE WHEN NOT du THEN 'duration_consistency' END, CASE WHEN NOT res THEN 'resolution_consistency' END) AS failed FROM k)"""


def _checks(spark, sf):
    return integrity.sample_checks(fx.samples(spark, sf), fx.inventory(spark, sf))


@query("VI1_VI2_JN2", f"{_CHECKS} SELECT sample_id, fc AS frame_count_consistency, res AS resolution_consistency FROM f")
def vi12(spark, sf):
    return _checks(spark, sf).select("sample_id", "frame_count_consistency", "resolution_consistency")


@query("VI3", f"{_CHECKS} SELECT sample_id, failed AS failed_checks, failed = '' AS valid FROM f")
def vi3(spark, sf):
    return _checks(spark, sf).select("sample_id", F.array_join("failed_checks", ",").alias("failed_checks"), "valid")


@query("VI4", f"{_CHECKS} SELECT count(*) AS num_samples, count(*) FILTER (failed = '') AS valid_sample_count, count(*) FILTER (failed <> '') AS invalid_sample_count, round(count(*) FILTER (failed = '') / count(*), 6) AS pass_rate, 'success' AS status FROM f")
def vi4(spark, sf):
    return integrity.summary(_checks(spark, sf)).select("num_samples", "valid_sample_count", "invalid_sample_count", *r6("pass_rate"), "status")


@query("FLT4", """SELECT c_custkey, c_acctbal > 0 AS positive FROM customer""")
def flt4(spark, sf):
    from framelens.functions.numeric import positive

    return fx.table(spark, sf, "customer").select("c_custkey", positive(F.col("c_acctbal")).alias("positive"))


@query("AGG1_AGG2_AGG3", """SELECT o_orderpriority, round(avg(x), 6) AS mean, round(CASE WHEN count(*) FILTER (x > 2) = 0 THEN 0.0 ELSE sum(x) / count(*) FILTER (x > 2) END, 6) AS ratio, round(least(greatest(avg(x), 0.0), 1.0), 6) AS clamped
    FROM (SELECT o_orderpriority, o_totalprice / 1e5 - 1 AS x FROM orders) GROUP BY o_orderpriority""")
def agg123(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5 - 1).alias("x"))
    out = o.groupBy("o_orderpriority").agg(F.avg("x").alias("mean"), safe_div(F.sum("x"), F.count_if(F.col("x") > 2)).alias("ratio"))
    return out.withColumn("clamped", clamp01(F.col("mean"))).select("o_orderpriority", *r6("mean", "ratio", "clamped"))


# Instances

_TRACK = "sample_id, view, object_id"
_CLASS = f"cl AS (SELECT {_TRACK}, max(n) / sum(n) AS class_score FROM (SELECT {_TRACK}, label, count(*) AS n FROM l GROUP BY ALL) GROUP BY {_TRACK})"
_CONF = f"cf AS (SELECT {_TRACK}, avg(c) / (1 + CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_pop(c) END) AS confidence_score FROM (SELECT *, least(greatest(conf, 0.0), 1.0) AS c FROM l) GROUP BY {_TRACK})"
_GEO = f"""st AS (SELECT *, sqrt(pow(x + w / 2 - lag(x + w / 2) OVER k, 2) + pow(y + h / 2 - lag(y + h / 2) OVER k, 2)) AS step FROM b WINDOW k AS (PARTITION BY {_TRACK} ORDER BY fr)),
    g AS (SELECT {_TRACK}, count(*) AS n, max(fr) - min(fr) + 1 AS span, stddev_pop(step) AS a, stddev_pop(ln(w * h)) AS s, stddev_pop(ln(w / h)) AS r FROM st GROUP BY {_TRACK} HAVING count(*) >= 2),
    ge AS (SELECT {_TRACK}, 0.35 / (1 + a) + 0.2 / (1 + s) + 0.2 / (1 + r) + 0.15 * (n / span) + 0.1 * (n / span) AS geometry_score FROM g)"""


@query("IN1", f"WITH {SQL['labelled']}, {_CLASS} SELECT {_TRACK}, round(class_score, 6) AS class_score FROM cl")
def in1(spark, sf):
    return instances.label_stability(fx.labelled(spark, sf)).select("sample_id", "view", "object_id", *r6("class_score"))


@query("IN2_TOP1", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN CASE WHEN value >= 50 THEN 'car' ELSE 'truck' END WHEN 2 THEN event_type WHEN 4 THEN 'bus' WHEN 5 THEN 'None' ELSE NULL END AS label, round(CASE event_id % 6 WHEN 0 THEN least(value / 100, 1.0) WHEN 1 THEN CASE WHEN value >= 50 THEN least(value / 100, 1.0) ELSE 0.5 END WHEN 3 THEN least(value / 100, 1.0) WHEN 4 THEN 0.25 WHEN 5 THEN 1.0 END, 6) AS confidence FROM events""")
def in2(spark, sf):
    """Numbers in quotes don't count, a label that is null does, and true is one."""
    text = F.expr("""CASE event_id % 6 WHEN 0 THEN '{"label": "' || event_type || '", "confidence": ' || CAST(value / 100 AS string) || '}'
        WHEN 1 THEN '{"car": ' || CAST(value / 100 AS string) || ', "truck": 0.5}' WHEN 2 THEN '"' || event_type || '"' WHEN 4 THEN '{"car": "0.9", "bus": 0.25, "van": null}' WHEN 5 THEN '{"label": null, "score": "0.5", "x": true}' ELSE CAST(value / 100 AS string) END""")
    e = fx.table(spark, sf, "events").select("event_id", F.parse_json(text).alias("v"))
    return e.select("event_id", instances.top_label(F.col("v")).alias("label"), instances.confidence(F.col("v")).alias("confidence")).select("event_id", "label", *r6("confidence"))


@query("IN3", f"WITH {SQL['labelled']}, {_CONF} SELECT {_TRACK}, round(confidence_score, 6) AS confidence_score FROM cf")
def in3(spark, sf):
    return instances.confidence_stability(fx.labelled(spark, sf)).select("sample_id", "view", "object_id", *r6("confidence_score"))


@query("IN4_WIN4_SRT1", f"WITH {SQL['boxes']}, {_GEO} SELECT {_TRACK}, round(geometry_score, 6) AS geometry_score FROM ge")
def in4(spark, sf):
    return instances.geometry_coherence(fx.boxes(spark, sf)).select("sample_id", "view", "object_id", *r6("geometry_score"))


def _tracks(spark, sf):
    return instances.fused(instances.label_stability(fx.labelled(spark, sf)), instances.confidence_stability(fx.labelled(spark, sf)), instances.geometry_coherence(fx.boxes(spark, sf).where("object_id % 3 <> 0")))


_FUSED = f"""WITH {SQL['labelled']}, {SQL['boxes'].replace('FROM events)', 'FROM events WHERE user_id % 3 <> 0)')}, {_CLASS}, {_CONF}, {_GEO},
    fu AS (SELECT {_TRACK}, 0.35 * coalesce(class_score, 0) + 0.2 * coalesce(confidence_score, 0) + 0.45 * coalesce(geometry_score, 0) AS score FROM cl FULL JOIN cf USING ({_TRACK}) FULL JOIN ge USING ({_TRACK}))"""


@query("IN5_JN6", f"{_FUSED} SELECT {_TRACK}, round(score, 6) AS score FROM fu")
def in5(spark, sf):
    return _tracks(spark, sf).select("sample_id", "view", "object_id", *r6("score"))


@query("IN_outcomes", f"{_FUSED}, a AS (SELECT sample_id, view, avg(score) AS s FROM fu GROUP BY ALL), o AS (SELECT sample_id, avg(s) AS score FROM a GROUP BY ALL) SELECT 'instance_consistency' AS metric, sample_id, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'skipped' ELSE 'success' END AS status, CASE WHEN score IS NULL THEN 'no track could be scored' END AS reason FROM (SELECT 's' || i AS sample_id FROM (SELECT unnest(range(0, 9)) AS i)) LEFT JOIN o USING (sample_id)")
def in_outcomes(spark, sf):
    samples = spark.range(9).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id"))
    return instances.evaluate(samples, _tracks(spark, sf)).select("metric", "sample_id", *r6("score"), "status", "reason")


def _raw_tracks(spark, sf):
    """(sample_id, metadata): for each customer lists of tracks, side maps and older forms, in eight shapes."""
    shape = F.expr("""CASE c_custkey % 8
        WHEN 0 THEN '{"instance_tracks": {"camera_front": [{"object_id": "1", "class_scores": ["car", "car", "bus"]}]}}'
        WHEN 1 THEN '{"instance_tracks": {"camera_front": [{"object_id": "1", "identities": ["a", "b"]}]}, "object_class_scores": {"camera_front": {"1": [{"car": 0.9, "bus": 0.1}, {"label": "car", "score": 0.5}]}}}'
        WHEN 2 THEN '{"object_tracks": {"camera_front": [{"object_id": 0, "identities": "a"}, {"identities": ["a", "b", "b", "b"]}]}}'
        WHEN 3 THEN '{"objects": {"camera_rear": [{"object_id": "x", "class_scores": {"car": 0.8, "truck": 0.2}}]}}'
        WHEN 4 THEN '{"instance_tracks": [{"object_id": "1", "identities": ["a", null, "b"]}]}'
        WHEN 5 THEN '{"instance_tracks": {"camera_front": [{"object_id": "1", "class_scores": [], "boxes": [{"frame_index": 0, "bbox": [0, 0, 1, 1]}, {"frame_index": 1, "bbox": [0, 0, 1, 1]}]}]}, "num_frames": null}'
        WHEN 6 THEN '{"instance_tracks": {"camera_front": [{"object_id": "1"}]}, "object_crops": {"camera_front": {"1": ["c.png"]}}}'
        ELSE '{"object_identities": {"y": ["a", "a"]}}' END""")
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.parse_json(shape).alias("metadata"))


@query("IN1_IN3_JN6_raw", """WITH s(k, score, status, reason) AS (VALUES
        (0, 0.35 * 2 / 3, 'success', NULL), (1, 0.35 + 0.2 * (0.7 / 1.2), 'success', NULL), (2, (0.35 + 0.35 * 0.75) / 2, 'success', NULL), (3, 0.2 * (0.5 / 1.3), 'success', NULL), (4, 0.35 * 0.5, 'success', NULL),
        (5, NULL, 'failed', 'int() argument must be a string, a bytes-like object or a real number, not ''NoneType'''), (6, NULL, 'skipped', 'No usable prepared tracks found for expected views or legacy fallback.'), (7, 0.35, 'success', NULL))
    SELECT CAST(c_custkey AS VARCHAR) AS sample_id, round(score, 6) AS score, status, reason FROM customer JOIN s ON k = c_custkey % 8""")
def in_raw(spark, sf):
    """Instance consistency of raw metadata."""
    return facts.consistency_outcomes(_raw_tracks(spark, sf)).select("sample_id", *r6("score"), "status", "reason")


@query("JN7_raw", """WITH t(k, view, object_id, category, n_boxes, class_scores, identities, crops) AS (VALUES
        (0, 'camera_front', '1', 'x', 2, '["car"]', NULL, '["c.png"]'), (0, 'camera_front', 'new', NULL, 0, '{"bus":0.5}', NULL, NULL), (1, 'camera_front', 'track_0', NULL, 0, NULL, '["p"]', NULL), (1, 'camera_front', 'track_1', 'y', 0, NULL, '["q"]', NULL))
    SELECT CAST(c_custkey AS VARCHAR) AS sample_id, view, object_id, category, CAST(n_boxes AS INTEGER) AS n_boxes, class_scores, identities, crops FROM customer JOIN t ON k = c_custkey % 2""")
def jn7_raw(spark, sf):
    """All fields of tracks that several sources and side maps name: boxes join, of the others the first that is given stays."""
    one = """'{"instance_tracks": {"camera_front": [{"object_id": "1", "boxes": [{"frame_index": 0, "bbox": [0, 0, 1, 1]}], "class_scores": []}]}, "object_tracks": {"camera_front": [{"object_id": "1", "category": "x", "boxes_2d": [{"frame_index": 1, "bbox": [0, 0, 1, 1]}]}]}, "object_class_scores": {"camera_front": {"1": ["car"], "new": {"bus": 0.5}}}, "object_crops": {"camera_front": {"1": ["c.png"], "crop": ["d.png"]}}}'"""
    two = """'{"instance_tracks": {"camera_front": [{"identities": ["p"]}, {"object_id": "gone"}]}, "objects": {"camera_front": [{"object_id": 0, "category": "y", "identities": ["q"]}]}}'"""
    s = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.parse_json(F.expr(f"CASE c_custkey % 2 WHEN 0 THEN {one} ELSE {two} END")).alias("metadata"))
    return facts.tracks(s).select("sample_id", "view", "object_id", "category", F.size("boxes").alias("n_boxes"), *facts.FIELDS)


@query("IC2_metadata", """WITH s(k, status, reason) AS (VALUES (0, 'success', NULL), (1, 'success', NULL), (2, 'failed', 'TypeError'), (3, 'failed', 'ValueError'), (4, 'skipped', 'metadata[''object_features''] must be a non-empty dict.'), (5, 'skipped', 'No usable object feature sequence found in metadata[''object_features''].'))
    SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 END AS score, status, reason FROM customer JOIN s ON k = c_custkey % 6""")
def ic2_metadata(spark, sf):
    """Instance coherence of raw metadata: by view, of the older form, unreadable, ragged, missing and too short."""
    shape = F.expr("""CASE c_custkey % 6
        WHEN 0 THEN '{"object_features": {"camera_front": {"a": [[1, 0], [1, 0], [1, 0]], "b": [[1, 2]]}, "camera_rear": {"a": [[0, 3], [0, 2]]}}}'
        WHEN 1 THEN '{"object_features": {"a": [[1, 0], [0, 1]], "b": [[2, 2], [1, 1]], "c": [1, 2]}}'
        WHEN 2 THEN '{"object_features": {"camera_front": {"a": [[1, 2]]}}}'
        WHEN 3 THEN '{"object_features": {"camera_front": {"a": [[1, 2], [3]]}}}'
        WHEN 4 THEN '{"object_features": {}}' ELSE '{"object_features": {"a": [[1, 2]]}}' END""")
    s = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.parse_json(shape).alias("metadata"))
    reason = F.when(F.col("status") == "failed", F.substring_index("reason", ":", 1)).otherwise(F.col("reason"))
    return facts.coherence_outcomes(s).select("sample_id", *r6("score"), "status", reason.alias("reason"))


@query("FLT8_PRJ4", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS x1 FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def flt8(spark, sf):
    one, two = F.array(F.lit(1.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)), F.array(F.lit(2.0), F.lit(0.0), F.lit(5.0), F.lit(5.0))
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("frame_index"), F.when(F.col("event_id") % 5 == 0, one).otherwise(F.slice(one, 1, 0)).alias("bbox"), F.when(F.col("event_id") % 11 == 0, F.slice(two, 1, 3)).otherwise(two).alias("box"))
    e = e.withColumn("bbox", F.when(F.col("event_id") % 11 == 0, F.slice("bbox", 1, 0)).otherwise(F.col("bbox")))
    return instances.usable_boxes(e).select("event_id", F.col("bbox")[0].cast("int").alias("x1"))


@query("JN5_JN7", """WITH t AS (SELECT user_id, event_id, event_id % 2 AS src, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS cat FROM events)
    SELECT CAST(user_id % 7 AS VARCHAR) AS sample_id, CAST(user_id AS VARCHAR) AS object_id, arg_min(cat, src * 1000000000 + event_id) FILTER (cat IS NOT NULL) AS category, count(*) AS n_boxes, CAST(arg_max(event_id, src * 1000000000 + event_id) AS VARCHAR) AS last_seen FROM t WHERE user_id <> 0 GROUP BY user_id
    UNION ALL SELECT '0', 'track_' || (row_number() OVER (ORDER BY src, event_id) - 1), cat, 1, CAST(event_id AS VARCHAR) FROM t WHERE user_id = 0""")
def jn57(spark, sf):
    """Two sources of tracks; user 0 has a falsy id, so each of its rows becomes an anonymous track."""
    e = fx.table(spark, sf, "events")
    rows = e.select((F.col("user_id") % 7).cast("string").alias("sample_id"), F.lit("v").alias("view"), F.col("event_id").alias("position"), F.col("user_id").cast("string").alias("object_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("category"), F.array("event_id").alias("boxes"), F.create_map(F.lit("seen"), F.col("event_id").cast("string")).alias("attributes"))
    both = instances.tracks_union(rows.where("position % 2 = 0"), rows.where("position % 2 = 1"))
    return instances.merged_tracks(both).select("sample_id", "object_id", "category", F.size("boxes").cast("long").alias("n_boxes"), F.col("attributes")["seen"].alias("last_seen"))


@query("FLT7", """SELECT event_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def flt7(spark, sf):
    some, none = F.array(F.lit(1)), F.slice(F.array(F.lit(1)), 1, 0)
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, some).otherwise(none).alias("boxes"), F.when(F.col("event_id") % 3 == 0, some).alias("class_scores"), none.alias("identities"))
    return e.where(instances.has_signal()).select("event_id")


# Semantic masks

_LFR = f"""WITH {SQL['masks']},
    i AS (SELECT *, coalesce(lag(c) OVER r = c, true) AND coalesce(lag(c) OVER k = c, true) AS lu, coalesce(lag(c) OVER r = c, true) AS l FROM masks WINDOW r AS (PARTITION BY sample_id, t, y ORDER BY x), k AS (PARTITION BY sample_id, t, x ORDER BY y)),
    n AS (SELECT *, lu AND coalesce(lag(l) OVER (PARTITION BY sample_id, t, x ORDER BY y), true) AS ins FROM i),
    w AS (SELECT *, lag(c) OVER z AS pc, lag(ins) OVER z AS pin FROM n WINDOW z AS (PARTITION BY sample_id, y, x ORDER BY t)),
    pr AS (SELECT sample_id, t, avg(CASE WHEN ins AND pin THEN CAST(c <> pc AS INTEGER) END) AS fl FROM w GROUP BY sample_id, t),
    lfr AS (SELECT sample_id, coalesce(least(greatest(1 - avg(fl), 0.0), 1.0), 1.0) AS lfr FROM pr GROUP BY sample_id)"""


@query("SM1_WIN6_JN4", f"{_LFR} SELECT sample_id, round(lfr, 6) AS lfr FROM lfr")
def sm1(spark, sf):
    return semantic.flip_rates(fx.packed_masks(spark, sf)).select("sample_id", *r6("lfr"))


_HIST = f"""WITH {SQL['masks']}, fr AS (SELECT sample_id, t, count(*) AS n FROM masks GROUP BY ALL), k AS (SELECT unnest(range(0, 3)) AS c),
    h AS (SELECT fr.sample_id, fr.t, k.c, (count(m.c) + 1e-8) / (any_value(n) + 3e-8) AS p FROM fr CROSS JOIN k LEFT JOIN masks m ON m.sample_id = fr.sample_id AND m.t = fr.t AND m.c = k.c GROUP BY ALL)"""


@query("SM4", f"""{_HIST}, j AS (SELECT a.sample_id, a.t, sum(0.5 * a.p * ln(a.p / ((a.p + b.p) / 2)) + 0.5 * b.p * ln(b.p / ((a.p + b.p) / 2))) AS js FROM h a JOIN h b ON a.sample_id = b.sample_id AND a.c = b.c AND b.t = a.t - 1 GROUP BY ALL)
    SELECT sample_id, round(coalesce(least(greatest(1 - avg(js), 0.0), 1.0), 1.0), 6) AS cds FROM (SELECT DISTINCT sample_id FROM fr) LEFT JOIN j USING (sample_id) GROUP BY sample_id""")
def sm4(spark, sf):
    return semantic.distribution_shift(fx.packed_masks(spark, sf), 3).select("sample_id", *r6("cds"))


@query("SM4_histograms", f"{_HIST} SELECT sample_id, t, c AS class_id, round(p, 6) AS p FROM h")
def sm4_histograms(spark, sf):
    return semantic.histograms(fx.masks(spark, sf), 3).select("sample_id", F.col("t").cast("long").alias("t"), F.col("class_id").cast("long").alias("class_id"), *r6("p"))


_COMPONENTS = f"""WITH RECURSIVE {SQL['masks']}, px2 AS (SELECT sample_id, t, y * 8 + x AS p, c FROM masks),
    st AS (SELECT a.sample_id, a.t, a.p, b.p AS q FROM px2 a JOIN px2 b ON a.sample_id = b.sample_id AND a.t = b.t AND a.c = b.c AND (b.p = a.p + 8 OR b.p = a.p - 8 OR (b.p = a.p + 1 AND b.p % 8 > 0) OR (b.p = a.p - 1 AND a.p % 8 > 0))),
    cl AS (SELECT sample_id, t, p AS a, p AS b FROM px2 UNION SELECT cl.sample_id, cl.t, cl.a, st.q FROM cl JOIN st ON cl.sample_id = st.sample_id AND cl.t = st.t AND cl.b = st.p),
    lb AS (SELECT sample_id, t, a AS p, min(b) AS root FROM cl GROUP BY ALL),
    co AS (SELECT lb.sample_id, lb.t, lb.p, c, dense_rank() OVER (PARTITION BY lb.sample_id, lb.t ORDER BY root) AS component FROM lb JOIN px2 USING (sample_id, t, p))"""


@query("SM2", f"{_COMPONENTS} SELECT sample_id, t, component, c AS class_id, count(*) AS area FROM co GROUP BY ALL")
def sm2(spark, sf):
    return semantic.component_table(fx.packed_masks(spark, sf)).select("sample_id", "t", "component", "class_id", "area")


@query("JN9", f"{_COMPONENTS} SELECT b.sample_id, b.t, a.component, b.component AS after, count(*) AS shared FROM co a JOIN co b ON a.sample_id = b.sample_id AND a.t = b.t - 1 AND a.p = b.p AND a.c = b.c GROUP BY ALL")
def jn9(spark, sf):
    return semantic.component_overlaps(fx.packed_masks(spark, sf)).select("sample_id", "t", "component", "after", "shared")


@query("SM3_JN10")
def sm3(spark, sf):
    """The optimal matching of components has no SQL form."""
    return semantic.area_consistency(fx.packed_masks(spark, sf)).select("sample_id", *r6("sac"))


@query("SM5")
def sm5(spark, sf):
    return semantic.clip_scores(fx.packed_masks(spark, sf)).select("sample_id", *r6("score"))


@query("SM6_SM7_FLT6", f"""WITH {SQL['masks']}, k AS (SELECT sample_id, max(c) + 1 AS most FROM masks GROUP BY ALL)
    SELECT sample_id, CAST(CASE WHEN CAST(substr(sample_id, 2) AS INTEGER) % 3 = 0 THEN 5 WHEN CAST(substr(sample_id, 2) AS INTEGER) % 3 = 1 THEN 4 ELSE most END AS INTEGER) AS num_classes FROM k WHERE CAST(substr(sample_id, 2) AS INTEGER) % 4 <> 3""")
def sm6(spark, sf):
    n = F.substring("sample_id", 2, 9).cast("int")
    given = fx.masks(spark, sf).select("sample_id").distinct().select("sample_id", F.when(n % 3 == 0, F.create_map(F.lit("v"), F.lit(5))).alias("per_view"), F.when(n % 3 <= 1, 4).alias("overall"), F.when(n % 4 == 3, F.create_map(F.lit("v"), F.lit(-7))).alias("label_per_view"), F.lit(None).cast("int").alias("label_overall"))
    counted = semantic.class_counts(fx.masks(spark, sf), given.select("sample_id", "per_view", "overall"))
    labels = semantic.matching_label(counted.join(given.select("sample_id", "label_per_view", "label_overall"), "sample_id"))
    return labels.select("sample_id", "num_classes")


# Views

_VW = f"WITH {SQL['matches']}, fs AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE conf * least(1.0, n / 50.0) END AS score FROM m), ps AS (SELECT c_custkey, cam_a, cam_b, avg(score) AS score FROM fs GROUP BY ALL)"


@query("VW1", f"{_VW} SELECT CAST(c_custkey AS VARCHAR) AS sample_id, cam_a, cam_b, round(score, 6) AS score, CAST(0 AS BIGINT) AS n_failed FROM ps")
def vw1(spark, sf):
    return views.pair_scores(views.frame_scores(fx.matches(spark, sf))).select("sample_id", "cam_a", "cam_b", *r6("score"), "n_failed")


@query("VW2_JN3", f"{_VW} SELECT 'view_consistency' AS metric, CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN count(*) = 6 THEN round(avg(score), 6) END AS score, CASE WHEN count(*) = 6 THEN 'success' ELSE 'skipped' END AS status, CASE WHEN count(*) < 6 THEN 'some camera pair could not be scored' END AS reason FROM ps GROUP BY c_custkey")
def vw2(spark, sf):
    return views.evaluate(fx.samples(spark, sf), fx.matches(spark, sf)).select("metric", "sample_id", *r6("score"), "status", "reason")


@query("JN3", f"""WITH {SQL['inventory']}, pr(cam_a, cam_b) AS (VALUES ('camera_front', 'camera_cross_left'), ('camera_front', 'camera_cross_right'), ('camera_cross_left', 'camera_rear_left'), ('camera_cross_right', 'camera_rear_right'), ('camera_rear_left', 'camera_rear'), ('camera_rear_right', 'camera_rear'))
    SELECT CAST(a.c_custkey AS VARCHAR) AS sample_id, cam_a, cam_b, a.c_custkey || a.view AS path_a, b.c_custkey || b.view AS path_b FROM pr JOIN inv a ON a.view = cam_a JOIN inv b ON b.view = cam_b AND b.c_custkey = a.c_custkey""")
def jn3(spark, sf):
    paths = fx.inventory(spark, sf).select("sample_id", "view", F.concat("sample_id", "view").alias("path"))
    return views.pair_videos(paths).select("sample_id", "cam_a", "cam_b", "path_a", "path_b")


# Accounting

_SUM = f"WITH {SQL['outcomes']}, sm AS (SELECT metric, count(*) AS num_samples, count(*) FILTER (status = 'success') AS evaluated_count, count(*) FILTER (status = 'skipped') AS skipped_count, count(*) FILTER (status = 'failed') AS failed_count, avg(score) AS mean_score FROM oc GROUP BY metric), su AS (SELECT * , CASE WHEN mean_score IS NOT NULL THEN 'success' WHEN failed_count > 0 THEN 'failed' ELSE 'skipped' END AS status FROM sm)"


@query("ACC1_ACC2_RPT1_PRJ8", f"{_SUM} SELECT metric, num_samples, evaluated_count, skipped_count, failed_count, round(mean_score, 6) AS mean_score, status FROM su")
def acc1(spark, sf):
    return outcomes.metric_summary(fx.outcomes(spark, sf)).select("metric", "num_samples", "evaluated_count", "skipped_count", "failed_count", *r6("mean_score"), "status")


@query("RPT2_PRJ7", f"{_SUM} SELECT metric, status, sample_id, reason FROM oc WHERE status <> 'success'")
def rpt2(spark, sf):
    return outcomes.failed_samples(fx.outcomes(spark, sf))


@query("RPT3", f"{_SUM} SELECT CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'success' END AS status FROM su")
def rpt3(spark, sf):
    return outcomes.overall_status(outcomes.metric_summary(fx.outcomes(spark, sf)))


@query("VIS4", """WITH t AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 89 = 0 THEN 'partial' ELSE 'success' END AS s FROM events)
    SELECT CAST(user_id AS VARCHAR) AS target, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'partial') OR (bool_or(s = 'success') AND bool_or(s = 'skipped')) THEN 'partial' WHEN bool_or(s = 'success') THEN 'success' ELSE 'skipped' END AS status FROM t GROUP BY user_id""")
def vis4(spark, sf):
    s = F.when(F.col("event_id") % 97 == 0, "failed").when(F.col("event_id") % 3 == 0, "skipped").when(F.col("event_id") % 89 == 0, "partial").otherwise("success")
    return outcomes.target_status(fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("target"), s.alias("status")))


@query("VIS2", """WITH s AS (SELECT c_custkey, v, CASE WHEN v = 0 THEN 2 ELSE 4 END AS h, CASE WHEN v = 0 THEN 3 ELSE 3 END AS w FROM customer, (SELECT unnest(range(0, 6)) AS v) WHERE c_custkey % 10 <> 5),
    g AS (SELECT c_custkey, v, h, ty, tx FROM s, (SELECT unnest(range(0, 2)) AS ty), (SELECT unnest(range(0, 3)) AS tx))
    SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST((v // 3) * 2 + ty AS INTEGER) AS y, CAST((v % 3) * 3 + tx AS INTEGER) AS x, CAST(v * 100 + floor((ty + 0.5) * h / 2.0) * 10 + tx AS INTEGER) AS value FROM g""")
def vis2(spark, sf):
    """Every tenth customer lacks a view, so that it gets no mosaic."""
    c = fx.table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v")).where("NOT (c_custkey % 10 = 5 AND v = 4)")
    h = F.when(F.col("v") == 0, 2).otherwise(4)
    t = c.withColumn("h", h).withColumn("w", F.lit(3)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(2))))
    t = t.select(F.col("c_custkey").cast("string").alias("sample_id"), F.expr(fx.VIEW_CASE).alias("view"), "h", "w", "y", "x", (F.col("v") * 100 + F.col("y") * 10 + F.col("x")).alias("value"))
    return visual.mosaic(t)
