"""Queries of ingestion, selection, enrichment and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import numeric, text
from framelens.operators import enrich, selection, shards
from framelens.plans import registry
from framelens.queries import fixtures as fx
from framelens.queries.base import query, r6
from framelens.queries.fixtures import SQL
from framelens.sources import files, manifest

_MISSING = "missing expected camera views: camera_front, camera_rear"
SEEN = f"""WITH r AS (SELECT c_custkey AS index, c_custkey % 10 AS k,
        CASE c_custkey % 10 WHEN 1 THEN 'index_' || c_custkey WHEN 2 THEN 'index_' || c_custkey WHEN 6 THEN 'index_' || c_custkey WHEN 7 THEN CAST(c_custkey AS VARCHAR) WHEN 9 THEN 'None' ELSE 's' || c_custkey END AS sample_id,
        CASE c_custkey % 10 WHEN 1 THEN 'sample must be an object' WHEN 2 THEN 'sample_id is required and must be non-empty' WHEN 3 THEN 'metadata must be an object when provided'
            WHEN 4 THEN 'metadata[''camera_videos''] is required' WHEN 5 THEN 'metadata[''camera_videos''] is required' WHEN 6 THEN 'sample_id is required and must be non-empty; metadata[''camera_videos''] must be a dict when provided'
            WHEN 7 THEN '{_MISSING}' WHEN 8 THEN 'camera_front path is required and must be non-empty; camera_cross_left path is required and must be non-empty' ELSE '' END AS reasons FROM customer)"""


@query("FLT1_JN1_SET2_SET3", f"{SEEN} SELECT index, sample_id, reasons, reasons = '' AS valid FROM r")
def flt1(spark, sf):
    return manifest.inspected(fx.manifest_records(spark, sf)).select("index", "sample_id", F.array_join("reasons", "; ").alias("reasons"), "valid")


@query("FLT2_SRC4", f"{SEEN} SELECT sample_id FROM r WHERE reasons = ''")
def flt2(spark, sf):
    return manifest.normalized(fx.manifest_records(spark, sf)).select("sample_id")


@query("INS1", f"{SEEN} SELECT count(*) AS num_samples, count(*) FILTER (reasons = '') AS num_valid, count(*) FILTER (reasons <> '') AS num_invalid FROM r")
def ins1(spark, sf):
    return manifest.inspection(fx.manifest_records(spark, sf))


@query("SRC3", f"{SEEN} SELECT index FROM r WHERE k <> 1")
def src3(spark, sf):
    return manifest.only_objects(fx.manifest_records(spark, sf)).select("index")


@query("PRJ1_PRJ2_PRJ3", f"""{SEEN} SELECT sample_id, CASE WHEN k = 9 THEN '7' ELSE 'g' || index END AS generated_video, CAST(CASE WHEN k = 9 THEN 1 ELSE 0 END AS INTEGER) AS n_objects, CASE WHEN k = 9 THEN 'o1' END AS object_id, 6 AS n_views, CASE WHEN k = 9 THEN 'f' ELSE 'camera_front.mp4' END AS front FROM r WHERE reasons = ''""")
def prj123(spark, sf):
    n = manifest.normalized(fx.manifest_records(spark, sf))
    return n.select("sample_id", "generated_video", F.size("objects").alias("n_objects"), F.try_element_at("objects", F.lit(1))["object_id"].alias("object_id"), F.size("camera_videos").alias("n_views"), F.col("camera_videos")["camera_front"].alias("front"))


@query("SRC1_SRC2_SRC7", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'top-level list' WHEN 1 THEN 'payload[''items'']' WHEN 2 THEN 'top-level dict' END AS name, CAST(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS INTEGER) AS n FROM customer""")
def src7(spark, sf):
    body = F.when(F.col("c_custkey") % 4 == 0, "[1, 2, 3]").when(F.col("c_custkey") % 4 == 1, '{"data": 3, "items": [4, {"a": 1}]}').when(F.col("c_custkey") % 4 == 2, '{"tag": [1, 2]}').otherwise("7")
    c = fx.table(spark, sf, "customer").select("c_custkey", F.parse_json(body).alias("payload"))
    return c.select("c_custkey", manifest.container(F.col("payload")).alias("c")).select("c_custkey", "c.name", F.when(F.col("c").isNotNull(), F.size("c.items")).alias("n"))


@query("PRJ6_preview", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[BIGINT, STRING]' WHEN 1 THEN '{a: BIGINT, b: STRING}' WHEN 2 THEN '{x: ARRAY, y: OBJECT}' ELSE 'VOID' END AS preview FROM customer""")
def prj6(spark, sf):
    body = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '[1, "s", true]' WHEN 1 THEN '{"c": 1, "b": "t", "a": 2}' WHEN 2 THEN '{"y": {"z": 1}, "x": []}' ELSE 'null' END""")
    return fx.table(spark, sf, "customer").select("c_custkey", manifest.preview(F.parse_json(body), 2).alias("preview"))


@query("SRC2_records", """SELECT c_custkey, CAST(i AS INTEGER) AS index FROM customer, (SELECT unnest(range(0, 3)) AS i) WHERE i < 1 + c_custkey % 3""")
def src2(spark, sf):
    n = F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))
    body = F.when(F.col("c_custkey") % 2 == 0, F.to_json(n)).otherwise(F.to_json(F.struct(n.alias("samples"))))
    return manifest.records(fx.table(spark, sf, "customer").select("c_custkey", F.parse_json(body).alias("payload"))).select("c_custkey", "index")


@query("SRC9", """SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 > 0 THEN round((c_custkey % 7) / (c_custkey % 5)::DOUBLE, 6) END AS duration, c_custkey % 3 > 0 AND (c_custkey % 2 = 0 OR c_custkey % 7 > 0) AS readable FROM customer""")
def src9(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("frame_count"), (F.col("c_custkey") % 5).cast("double").alias("fps"), (F.col("c_custkey") % 3).alias("width"), F.lit(9).alias("height"), F.when(F.col("c_custkey") % 2 == 0, "imageio").otherwise("cv2").alias("backend"))
    return files.video_properties(c).select("c_custkey", *r6("duration"), "readable")


@query("SRC14_SRT2", f"""WITH {SQL['paths']}, f AS (SELECT key // 4 AS video, path || CASE WHEN key % 3 = 0 THEN '.MP4' WHEN key % 3 = 1 THEN '.txt' ELSE '' END AS path, key % 3 = 0 AS is_video FROM paths)
    SELECT video, path FROM f QUALIFY is_video OR NOT bool_or(is_video) OVER (PARTITION BY video)""")
def src14(spark, sf):
    p = fx.paths(spark, sf).select(F.expr("key div 4").alias("video"), F.concat("path", F.when(F.col("key") % 3 == 0, ".MP4").when(F.col("key") % 3 == 1, ".txt").otherwise("")).alias("path"))
    return files.candidates(p)


@query("SRC15_SRC16_WIN8", """WITH f AS (SELECT CAST(c_custkey // 3 AS VARCHAR) AS sample_id, CASE c_custkey % 3 WHEN 0 THEN 'a/camera_rear_left_' || c_custkey WHEN 1 THEN 'b/camera_front' WHEN 2 THEN 'c/camera_rear_' || c_custkey END AS path FROM customer),
    h AS (SELECT sample_id, path, v FROM f, (SELECT unnest(['camera_front', 'camera_cross_left', 'camera_cross_right', 'camera_rear_left', 'camera_rear_right', 'camera_rear']) AS v) WHERE contains(path, v))
    SELECT sample_id, v AS view, min(path) AS path FROM h GROUP BY ALL""")
def src16(spark, sf):
    k = F.col("c_custkey")
    f = fx.table(spark, sf, "customer").select(F.expr("c_custkey div 3").cast("string").alias("sample_id"), F.when(k % 3 == 0, F.concat(F.lit("a/camera_rear_left_"), k.cast("string"))).when(k % 3 == 1, "b/camera_front").otherwise(F.concat(F.lit("c/camera_rear_"), k.cast("string"))).alias("path"))
    return files.first_of_view(f).select("sample_id", "view", "path")


# Strings and paths

_NORM = "trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_')"
_VIEW = "CASE WHEN regexp_matches(n, 'tele|long|zoom') THEN NULL " + " ".join(f"WHEN {' OR '.join(f'''contains(n, '{a}')''' for a in aliases)} THEN '{view}'" for view, aliases in text.VIEW_ALIASES) + " END"


@query("STR1", r"SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'unknown' ELSE regexp_replace(url, '[^\p{L}\p{N}_.-]', '_', 'g') END AS safe FROM pages")
def str1(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.safe_path_part(F.col("url")).alias("safe"))


@query("STR2", f"WITH paths AS (SELECT page_id AS key, url AS path FROM pages) SELECT key, {_NORM} AS name FROM paths")
def str2(spark, sf):
    return fx.table(spark, sf, "pages").select(F.col("page_id").alias("key"), text.normal_name(F.col("url")).alias("name"))


@query("STR3_FLT5", f"WITH {SQL['paths']}, n AS (SELECT key, {_NORM} AS n FROM paths) SELECT key, {_VIEW} AS view FROM n")
def str3(spark, sf):
    return fx.paths(spark, sf).select("key", text.view_of(F.col("path")).alias("view"))


def _files_sql(per: int) -> str:
    return f"""WITH {SQL['paths']}, f AS (SELECT 'v' || (key // {per}) AS video, CASE WHEN key % 8 = 5 AND (key // {per}) % 3 = 0 THEN replace(path, '/back/', '/roof/') ELSE path END AS path FROM paths), n AS (SELECT *, {_NORM} AS n, string_split(path, '/') AS parts FROM f), w AS (SELECT *, {_VIEW} AS view FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY video, view ORDER BY parts) AS k FROM w),
    o(view, r) AS (VALUES ('camera_front', 1), ('camera_cross_left', 2), ('camera_cross_right', 3), ('camera_rear_left', 4), ('camera_rear_right', 5), ('camera_rear', 6)),
    v AS (SELECT DISTINCT video FROM f), e AS (SELECT DISTINCT 'none' || video AS video FROM f),
    ms AS (SELECT v.video, string_agg(o.view, ', ' ORDER BY r) AS miss FROM v CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.video = v.video AND k.view = o.view) GROUP BY v.video),
    tw AS (SELECT video, arg_min(view, parts) AS twice FROM k WHERE k = 2 AND view IS NOT NULL GROUP BY video)
    SELECT video, CASE WHEN twice IS NOT NULL THEN 'multiple files matched view \'\'' || twice || '\'\': ' || video WHEN miss IS NOT NULL THEN 'missing expected views: ' || miss END AS reason FROM v LEFT JOIN ms USING (video) LEFT JOIN tw USING (video)
    UNION ALL SELECT video, 'video path cannot be expanded: ' || video AS reason FROM e""".replace("\\'", "'")


def _resolved(spark, sf, per: int):
    """Files of every part; each third video has a roof camera for its rear one, and as many videos have no file."""
    k = F.expr(f"key div {per}")
    f = fx.paths(spark, sf).select(F.concat(F.lit("v"), k.cast("string")).alias("video"), F.when((F.col("key") % 8 == 5) & (k % 3 == 0), F.regexp_replace("path", "/back/", "/roof/")).otherwise(F.col("path")).alias("path"))
    videos = f.select("video").unionByName(f.select(F.concat(F.lit("none"), "video").alias("video")))
    return selection.resolved_views(f, videos).select("video", "reason")


@query("STR4", _files_sql(24))
def str4(spark, sf):
    return _resolved(spark, sf, 24)


@query("STR4_valid", _files_sql(8))
def str4_valid(spark, sf):
    return _resolved(spark, sf, 8)


@query("STR7", f"{SEEN} SELECT sample_id, reasons AS joined, CASE WHEN reasons = '' THEN 0 ELSE length(reasons) - length(replace(reasons, ';', '')) + 1 END AS n FROM r")
def str7(spark, sf):
    """Lists of reasons, joined."""
    return manifest.inspected(fx.manifest_records(spark, sf)).select("sample_id", F.array_join("reasons", "; ").alias("joined"), F.size("reasons").alias("n"))


@query("SET4", "SELECT left(r_name, 1) AS name, max(r_regionkey) AS rank, row_number() OVER (ORDER BY min(r_regionkey)) - 1 AS place FROM region GROUP BY 1")
def set4(spark, sf):
    """Configurations named by the first letters of regions: of each name the last one, at the place of the first."""
    configs = [{"name": r.r_name[0], "rank": r.r_regionkey} for r in fx.table(spark, sf, "region").orderBy("r_regionkey").collect()]
    found = registry.last_configs(configs)
    return spark.createDataFrame([(c["name"], c["rank"], i) for i, c in enumerate(found)], "name string, rank long, place long")


@query("STR5", r"""SELECT page_id, 'ds_' || coalesce(nullif(trim(regexp_replace(coalesce(nullif(trim(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)), ''), 'sample'), '[^a-zA-Z0-9_-]+', '_', 'g'), '_'), ''), 'sample') || '_' || substr(sha1(url), 1, 12) AS sample_id FROM pages""")
def str5(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.sample_id(F.lit("ds"), F.col("url")).alias("sample_id"))


@query("STR6", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'real' || o_orderkey END AS dataset_name, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS data_count, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') END AS timestamp FROM orders""")
def str6(spark, sf):
    name = F.concat(F.lit("out/real"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("_"), text.run_id(F.col("o_orderdate")), F.lit(".json"))
    return fx.table(spark, sf, "orders").select("o_orderkey", text.run_context(name).alias("c")).select("o_orderkey", "c.*")


@query("DT1", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS run_id FROM events")
def dt1(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text.run_id(F.col("ts")).alias("run_id"))


@query("PTH1", """SELECT p_partkey, '/data/' || p_brand || '/x.mp4' AS path, 'x' AS stem, '.mp4' AS suffix FROM part""")
def pth1(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", text.normal_path(F.concat(F.lit("/data//./a/../"), F.col("p_brand"), F.lit("/b/../x.mp4"))).alias("path"))
    return p.select("p_partkey", "path", text.path_stem(F.col("path")).alias("stem"), text.path_suffix(F.col("path")).alias("suffix"))


@query("MTH1_MTH2", """SELECT p_partkey, CAST(CASE WHEN greatest(w, h) > 518 THEN greatest(1, round_even(w * 518.0::DOUBLE / greatest(w, h), 0)) ELSE w END AS INTEGER) AS fit_w, CAST(CASE WHEN greatest(w, h) > 518 THEN greatest(1, round_even(h * 518.0::DOUBLE / greatest(w, h), 0)) ELSE h END AS INTEGER) AS fit_h, CAST(greatest(1, floor(w * (1.0::DOUBLE / 3.0::DOUBLE))) AS INTEGER) AS crop, CAST(w // 8 * 8 AS INTEGER) AS aligned
    FROM (SELECT p_partkey, CAST(1 + p_partkey * 37 % 1500 AS INTEGER) AS w, CAST(1 + p_partkey * 53 % 900 AS INTEGER) AS h FROM part)""")
def mth12(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", (1 + F.col("p_partkey") * 37 % 1500).cast("int").alias("w"), (1 + F.col("p_partkey") * 53 % 900).cast("int").alias("h"))
    longest = F.greatest("w", "h")
    return p.select("p_partkey", numeric.fit_within(F.col("w"), longest, 518).alias("fit_w"), numeric.fit_within(F.col("h"), longest, 518).alias("fit_h"), numeric.crop_width(F.col("w")).alias("crop"), numeric.align_down(F.col("w")).alias("aligned"))


# Selection

@query("TAG1", f"""WITH {SQL['tagged']} SELECT tag, count(*) AS sample_count FROM tg GROUP BY tag UNION ALL SELECT 'not a list' AS tag, NULL AS sample_count""")
def tag1(spark, sf):
    index = fx.tagged(spark, sf).groupBy("tag").agg(F.collect_list("position").alias("items"))
    return selection.tag_summary(index.unionByName(spark.range(1).select(F.lit("not a list").alias("tag"), F.lit(None).cast("array<bigint>").alias("items"))))


@query("TAG2", f"""WITH {SQL['tagged']}, f AS (SELECT trim(video) AS video, tag, min(position) AS p FROM tg WHERE trim(video) <> '' GROUP BY ALL) SELECT video, min(p) AS first_position, string_agg(tag, ',' ORDER BY p) AS tags FROM f GROUP BY video""")
def tag2(spark, sf):
    return selection.unique_videos(fx.tagged(spark, sf)).select("video", "first_position", F.array_join("tags", ",").alias("tags"))


@query("TAG3", f"""WITH {SQL['tagged']}, a AS (SELECT count(*) AS n, count(DISTINCT CASE WHEN video IS NOT NULL OR hdmap IS NOT NULL THEN coalesce(video, 'None') || '|' || coalesce(hdmap, 'None') END) AS u FROM tg) SELECT n AS total_items, u AS unique_samples, n - u AS duplicate_items, round((n - u) / n, 6) AS duplicate_ratio FROM a""")
def tag3(spark, sf):
    return selection.dedup_stats(fx.tagged(spark, sf)).select("total_items", "unique_samples", "duplicate_items", *r6("duplicate_ratio"))


def _scan(spark, sf, size: int = 40):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("reason "), (F.col("c_custkey") % 4).cast("string"))).alias("reason"))
    return selection.selected(c, size, seed=3)


@query("SMP1", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 <> 0) AS valid FROM customer)
    SELECT least(40, valid) AS selected_count, n AS rank_count, true AS valid_only, true AS within, true AS complete FROM c""")
def smp1(spark, sf):
    """As many valid ones as asked for or there are; scanned ranks are the first ones, and end with a valid row; all ranks differ."""
    s = _scan(spark, sf).withColumn("ok", F.col("reason").isNull())
    last = F.max(F.when(F.col("scanned"), F.col("rank")))
    return s.agg(
        F.count_if("selected").alias("selected_count"), F.count_distinct("rank").alias("rank_count"), F.bool_and(~F.col("selected") | F.col("ok")).alias("valid_only"), (last == F.count_if("scanned")).alias("within"),
        (F.count_if(F.col("scanned") & F.col("ok")) == F.count_if("selected")).alias("complete"),
    )


@query("TAG4", "SELECT 'reason ' || (c_custkey % 4) AS reason, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
def tag4(spark, sf):
    """More are asked for than are valid, so that all are scanned: which come first, by a hash, is nothing SQL shares."""
    return selection.invalid_reasons(_scan(spark, sf, 1 << 40))


@query("PRJ5", """SELECT 'ds_v' || c_custkey || '_' || substr(sha1('v' || c_custkey), 1, 12) AS sample_id, 'f' || c_custkey AS generated_video, '' AS prompt, CAST(0 AS INTEGER) AS n_objects, 'v' || c_custkey AS source_video_dir FROM customer""")
def prj5(spark, sf):
    k = F.col("c_custkey").cast("string")
    c = fx.table(spark, sf, "customer").select(F.concat(F.lit("v"), k).alias("video"), F.array(F.lit("t")).alias("tags"), F.create_map(F.lit("camera_front"), F.concat(F.lit("f"), k)).alias("camera_videos"))
    return selection.payload(c, "ds").select("sample_id", "generated_video", "prompt", F.size("objects").alias("n_objects"), "metadata.source_video_dir")


@query("LIM1", "SELECT region, names FROM (SELECT o_orderpriority AS region, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS names FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_custkey) <= 3) GROUP BY 1)")
def lim1(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("region"), "o_orderkey", "o_custkey")
    out = shards.examples(o, ["region"], ["o_orderkey", "o_custkey"], 3)
    return out.select("region", F.array_join(F.transform("examples", lambda x: x["o_orderkey"].cast("string")), ",").alias("names"))


@query("PRT1_WIN7", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rank, (row_number() OVER (ORDER BY c_custkey) - 1) % 4 AS shard FROM customer")
def prt1(spark, sf):
    return shards.round_robin(fx.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 4)


@query("PRT2_SET1", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS shard, (row_number() OVER (ORDER BY o_orderkey) - 1) % 100 AS place FROM orders")
def prt2(spark, sf):
    """Contiguous shards of a hundred, and the union of even and odd ones in order."""
    out = shards.contiguous(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)
    both = shards.in_order([out.where("shard % 2 = 0"), out.where("shard % 2 = 1")], ["shard", "place"])
    return both.select("o_orderkey", "shard", "place")


@query("SET5", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set5(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey").join(fx.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Enrichment


def patches(spark, sf):
    o = fx.table(spark, sf, "orders")
    g = F.when(F.col("o_orderkey") % 3 == 0, "depth").when(F.col("o_orderkey") % 3 == 1, "semantic").otherwise("tracks")
    return o.select((F.col("o_custkey") % 500).cast("string").alias("sample_id"), g.alias("generator"), F.col("o_orderkey").cast("int").alias("rank"), F.create_map(F.lit("k"), F.col("o_orderkey").cast("string"), g, F.lit("y")).alias("patch"), F.when(F.col("o_orderkey") % 7 == 0, "ValueError: short").alias("error"))


@query("JN8_REF1", """WITH o AS (SELECT o_custkey % 500 AS s, CASE o_orderkey % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'semantic' ELSE 'tracks' END AS g, o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT CAST(i AS VARCHAR) AS sample_id, coalesce(CAST(max(o_orderkey) AS VARCHAR), 'old') AS k, 1 AS own, bool_or(g = 'depth') AS depth FROM (SELECT unnest(range(0, 500)) AS i) LEFT JOIN o ON s = i GROUP BY i""")
def jn8(spark, sf):
    samples = spark.range(500).select(F.col("id").cast("string").alias("sample_id"), F.create_map(F.lit("k"), F.lit("old"), F.lit("own"), F.lit("1")).alias("metadata"))
    out = enrich.enriched(samples, patches(spark, sf))
    return out.select("sample_id", F.col("metadata")["k"].alias("k"), F.col("metadata")["own"].cast("int").alias("own"), F.when(F.size("metadata") > 2, F.map_contains_key("metadata", "depth")).alias("depth"))


@query("REF2", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'semantic' ELSE 'tracks' END AS generator, count(*) FILTER (o_orderkey % 7 <> 0) AS prepared, count(*) FILTER (o_orderkey % 7 = 0) AS failed, round(count(*) FILTER (o_orderkey % 7 <> 0) / count(*), 6) AS coverage_ratio FROM orders GROUP BY 1""")
def ref2(spark, sf):
    return enrich.generator_summary(patches(spark, sf))


@query("REF3_REF4_SNK6", """SELECT CAST(c_custkey AS VARCHAR) AS sample_id FROM customer WHERE c_custkey % 4 <> 0""")
def ref34(spark, sf):
    c = fx.table(spark, sf, "customer")
    wanted = c.select(F.lit("depth").alias("generator"), F.col("c_custkey").cast("string").alias("sample_id"), F.lit("v").alias("view"))
    return enrich.to_generate(wanted, c.where("c_custkey % 4 = 0").select(F.lit("depth").alias("generator"), F.col("c_custkey").cast("string").alias("sample_id"), F.lit("v").alias("view"))).select("sample_id")
