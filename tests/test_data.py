"""Ingestion, files, selection, enrichment, plans and sinks."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.functions import numeric, text
from framelens.operators import enrich, selection
from framelens.plans import registry, runner, visual
from framelens.schema import VIEWS
from framelens.sources import files, manifest, sinks
from framelens.sources.registry import build_dataset, load_config, register_datasets
from framelens.streaming.incremental import score_stream

FULL = {v: f"{v}.mp4" for v in VIEWS}
RECORDS = [
    {"sample_id": " a ", "generated_video": "g", "objects": [{"object_id": "o", "category": "car", "boxes": [{"frame_index": 0, "bbox": [0, 0, 1, 1]}]}, 5], "metadata": {"camera_videos": {**FULL, "extra": None}}},
    7,
    {"sample_id": None, "metadata": {"camera_videos": FULL}},
    {"metadata": {"camera_videos": FULL}},
    {"sample_id": "b", "metadata": [1]},
    {"sample_id": "c", "metadata": None},
    {"sample_id": "d", "metadata": {"camera_videos": None}},
    {"sample_id": "e", "metadata": {"camera_videos": ["x"]}},
    {"sample_id": 12, "metadata": {"camera_videos": {v: p for v, p in FULL.items() if v != "camera_rear"}}},
    {"sample_id": "f", "metadata": {"camera_videos": {**FULL, "camera_front": None, "camera_rear": "  "}}},
]


@pytest.fixture(scope="module")
def manifest_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("m") / "real_10_20240101.json"
    p.write_text(json.dumps({"dataset_name": "real", "samples": RECORDS}))
    return str(p)


def test_manifest(spark, manifest_path):
    rows = manifest.records(manifest.read_payload(spark, manifest_path))
    seen = {r["index"]: (r.sample_id, r.reasons) for r in manifest.inspected(rows).select("index", "sample_id", "reasons").collect()}
    assert seen == {
        0: ("a", []), 1: ("index_1", ["sample must be an object"]), 2: ("None", []), 3: ("index_3", ["sample_id is required and must be non-empty"]), 4: ("b", ["metadata must be an object when provided"]),
        5: ("c", ["metadata['camera_videos'] is required"]), 6: ("d", ["metadata['camera_videos'] is required"]), 7: ("e", ["metadata['camera_videos'] must be a dict when provided"]),
        8: ("12", ["missing expected camera views: camera_rear"]), 9: ("f", ["camera_front path is required and must be non-empty", "camera_rear path is required and must be non-empty"]),
    }
    assert manifest.inspection(rows).first().asDict() == {"num_samples": 10, "num_valid": 2, "num_invalid": 8}
    n = {r.sample_id: r for r in manifest.normalized(rows).collect()}
    assert set(n) == {"a", "None"} and n["a"].camera_videos == FULL and n["a"].generated_video == "g" and n["a"].prompt == "" and [o.object_id for o in n["a"].objects] == ["o"] and n["None"].objects == []
    assert manifest.view_paths(manifest.normalized(rows)).count() == 12 and manifest.only_objects(rows).count() == 9
    register_datasets({"datasets": {"real": {}}})
    dataset = build_dataset("real", {"data_file": manifest_path})
    assert dataset.valid(spark).count() == 2
    with pytest.raises(Exception, match="invalid sample"):
        dataset.all(spark).collect()
    with pytest.raises(ValueError):
        build_dataset("other", {})
    with pytest.raises(ValueError):
        build_dataset("real", {}).records(spark)


def test_manifest_of_another_shape_raises(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"samples": 3}')
    with pytest.raises(Exception, match="top-level list"):
        manifest.records(manifest.read_payload(spark, str(tmp_path / "m.json"))).collect()


def test_containers(spark):
    cases = [("[1]", "top-level list", 1), ('{"data": 1, "items": [1, 2]}', "payload['items']", 2), ('{"a": [1], "b": [2]}', "top-level dict", 2), ("3", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string").select("i", manifest.container(F.parse_json("j")).alias("c"))
    assert {r.i: (r.name, r.n) for r in df.selectExpr("i", "c.name", "IF(c IS NULL, NULL, size(c.items)) AS n").collect()} == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_tensors_and_listing(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "flat.npy", np.arange(3))
    np.save(tmp_path / "object.npy", np.array([{}], dtype=object), allow_pickle=True)
    (tmp_path / "b.json").write_text(json.dumps(a.tolist()))
    (tmp_path / "c.mp4").write_bytes(b"x")
    rows = files.tensors(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    for name in ("a.npy", "b.json"):
        assert [np.array(r["values"]).reshape(r.h, r.w).tolist() for r in sorted(by[name], key=lambda r: r.t)] == a.tolist()
    assert "three dimensions" in by["flat.npy"][0].error and by["object.npy"][0].error.startswith("ValueError")
    listed = files.listing(spark, str(tmp_path))
    assert listed.count() == 5 and [r.path[-5:] for r in files.candidates(listed.withColumn("video", F.lit("x"))).collect()] == ["c.mp4"]
    assert files.view_images(listed, "a.npy").count() == 1
    decoded = files.frames(spark, str(tmp_path / "c.mp4"), lambda content: [content, content])
    assert [(r.frame_index, bytes(r.frame)) for r in decoded.collect()] == [(0, b"x"), (1, b"x")]
    packed = spark.createDataFrame([("g", "s", "v", t, 3, 4, [int(x) for x in a[t].ravel()]) for t in (1, 0)], "generator string, sample_id string, view string, t int, h int, w int, values array<int>")
    import io

    assert np.load(io.BytesIO(sinks.write_tensors(packed, str(tmp_path / "out")).first().npy)).tolist() == a.tolist()


def test_strings(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"x{i} string" for i in range(len(v)))).select(c).first()[0]
    x = F.col("x0")
    assert one(text.safe_path_part(x), "a b/é_1.-") == "a_b_é_1.-" and one(text.safe_path_part(x), "") == one(text.safe_path_part(x), None) == "unknown"
    assert one(text.normal_name(x), "/A//b-C.mp4") == "a_b_c_mp4"
    for path, view in [("x/Cross-Left.mp4", "camera_cross_left"), ("front_right", "camera_cross_right"), ("back", "camera_rear"), ("belongings/front", None), ("roof", None)]:
        assert one(text.view_of(x), path) == view
    import hashlib

    assert one(text.sample_id(F.lit("d"), x), "/p/my clip!/") == f"d_my_clip_{hashlib.sha1(b'/p/my clip!/').hexdigest()[:12]}"
    assert one(text.sample_id(F.lit("d"), x), "/") == f"d_sample_{hashlib.sha1(b'/').hexdigest()[:12]}"
    assert tuple(one(text.run_context(x), "/a/real_10_2024.json")) == ("real", 10, "2024") and tuple(one(text.run_context(x), "re_al_10_2024.json")) == (None, None, None)
    import os.path

    for p in ["a//b/./c", "/a/../../b", "../x/../y", "", "/", "a/..", "./"]:
        assert one(text.normal_path(x), p) == os.path.normpath(p or ".")
    from pathlib import PurePosixPath

    for p in ["a/b.tar.gz", ".hidden", "a/.x", "noext", "a/b.mp4"]:
        assert (one(text.path_stem(x), p), one(text.path_suffix(x), p)) == (PurePosixPath(p).stem, PurePosixPath(p).suffix)
    for side, longest in [(1000, 1036), (519, 1038), (7, 5000), (100, 200)]:
        want = max(1, round(side * 518 / longest)) if longest > 518 else side
        assert spark.range(1).select(numeric.fit_within(F.lit(side), F.lit(longest), 518)).first()[0] == want


def test_selection(spark):
    items = spark.createDataFrame([(0, "t", " a ", None), (1, "u", "a", "h"), (2, "t", "b", None), (3, "t", " ", None), (4, "u", None, None), (5, "t", "a", None)], "position int, tag string, video string, hdmap string")
    assert sorted((r.video, r.tags) for r in selection.unique_videos(items).collect()) == [("a", ["t", "u"]), ("b", ["t"])]
    assert selection.dedup_stats(items).first().asDict() == {"total_items": 6, "unique_samples": 5, "duplicate_items": 1, "duplicate_ratio": pytest.approx(1 / 6)}
    assert selection.dedup_stats(items.limit(0)).first().duplicate_ratio == 0
    index = spark.createDataFrame([("b", [1, 2]), ("a", [1, 2]), ("z", None), ("c", [])], "tag string, items array<int>")
    assert [(r.tag, r.sample_count) for r in selection.tag_summary(index).collect()] == [("a", 2), ("b", 2), ("c", 0), ("z", None)]
    names = ["front", "cross_left", "cross_right", "rear_left", "rear_right", "rear"]
    df = spark.createDataFrame([("ok", f"ok/{n}.mp4") for n in names] + [("two", f"two/{n}.mp4") for n in [*names, "cam_front"]] + [("few", "few/rear.mp4"), ("few", "few/tele_front.mp4")], "video string, path string")
    found = {r.video: r for r in selection.resolved_views(df).collect()}
    assert found["ok"].camera_videos["camera_rear"] == "ok/rear.mp4" and found["two"].reason == "multiple files matched view 'camera_front': two"
    assert found["few"].reason == "missing expected views: " + ", ".join(VIEWS[:5]) and found["few"].camera_videos is None
    pool = spark.createDataFrame([(f"v{i}", None if i % 3 else f"r{i % 2}") for i in range(300)], "video string, reason string")
    scan = selection.selected(pool, 50, seed=1).orderBy("rank").collect()
    valid = 0
    for i, r in enumerate(scan):
        assert r["rank"] == i + 1 and r.scanned == (valid < 50) and r.selected == (valid < 50 and r.reason is None)
        valid += r.reason is None
    assert [r.video for r in scan] == [r.video for r in selection.selected(pool.repartition(7), 50, seed=1).orderBy("rank").collect()] != [r.video for r in selection.selected(pool, 50, seed=2).orderBy("rank").collect()]
    assert sum(r.n for r in selection.invalid_reasons(selection.selected(pool, 50, seed=1)).collect()) == sum(r.scanned and r.reason is not None for r in scan)


def test_enrichment(spark):
    samples = spark.createDataFrame([("a", {"x": "1"}), ("b", None)], "sample_id string, metadata map<string,string>")
    patches = spark.createDataFrame([("a", "g", 0, {"x": "2", "y": "2"}, None), ("a", "h", 1, {"y": "3"}, None), ("b", "g", 0, None, "ValueError: no")], "sample_id string, generator string, rank int, patch map<string,string>, error string")
    assert {r.sample_id: r.metadata for r in enrich.enriched(samples, patches).collect()} == {"a": {"x": "2", "y": "3"}, "b": {}}
    assert {r.generator: (r.prepared, r.failed, r.coverage_ratio) for r in enrich.generator_summary(patches).collect()} == {"g": (1, 1, 0.5), "h": (1, 0, 1.0)}
    bad = spark.createDataFrame([("a", "g", 0, {"camera_videos": "2"}, None)], patches.schema)
    with pytest.raises(Exception, match="protected"):
        enrich.enriched(samples, bad).collect()
    wanted = spark.createDataFrame([("g", "a", "v"), ("g", "b", "v")], "generator string, sample_id string, view string")
    assert enrich.to_generate(wanted, wanted.limit(1)).count() == 1 and enrich.to_generate(wanted, wanted, force=True).count() == 2


def test_plans(spark, manifest_path, tmp_path, monkeypatch):
    assert runner.stage_switches(None, "evaluate, visualize") == {"inspect_data": False, "prepare_reference": False, "evaluate": True, "summarize": False, "visualize": True}
    assert all(runner.stage_switches(None, "all").values()) and runner.stage_switches() == {s: s in ("evaluate", "summarize") for s in runner.STAGES}
    with pytest.raises(ValueError):
        runner.stage_switches(None, "nothing")
    assert runner.overlay({"a": 1, "b": 2, "profile": "p", "profiles": {"p": {"b": 3}}}) == {"a": 1, "b": 3, "profile": "p"}
    assert runner.flat_metric({"metric": {"a": 1, "b": 1, "c": 1}, "model": {"b": 2, "c": 2}, "c": 3}) == {"a": 1, "b": 2, "c": 3}
    assert registry.enabled({"a": {"enabled": True}, "b": {}}) == ["a"] and registry.enabled({"a": {}, "b": {"enabled": False}}, default=True) == ["a"]
    assert registry.last_configs([{"name": "a", "x": 1}, {"name": "b"}, {"name": "a", "x": 2}]) == [{"name": "a", "x": 2}, {"name": "b"}]
    assert runner.probe(spark)["answers"] and runner.spark_settings({"num_shards": 4, "batch_size": 2})["spark.sql.shuffle.partitions"] == "4"
    with pytest.raises(ValueError):
        registry.build(registry.METRICS, "nothing")
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert load_config(str(tmp_path / "c.yaml")) == {"a": 1}
    monkeypatch.setitem(registry.GENERATORS, "flag", lambda s, c: s.select("sample_id", F.lit("flag").alias("generator"), F.lit(0).alias("rank"), F.create_map(F.lit("k"), F.lit("v")).alias("patch"), F.lit(None).cast("string").alias("error")))
    rng = np.random.default_rng(8)
    features = spark.createDataFrame([("a", v, t, [float(x) for x in rng.normal(size=3)]) for v in VIEWS for t in range(3)], "sample_id string, view string, frame_index int, feature array<double>")
    config = {"stage": "all", "metrics": {"temporal_consistency": {"enabled": True}}, "generators": {"flag": {}}}
    assert runner.run(spark, manifest_path, {"features": features}, config, str(tmp_path / "out")) == "success"
    report = json.loads((tmp_path / "out/summary.json").read_text())
    assert report["summary"]["temporal_consistency"]["valid_sample_count"] == 1 and report["summary"]["temporal_consistency"]["skipped_sample_count"] == 1 and report["summary"]["_failed_metrics"] == {}
    assert json.loads((tmp_path / "out/data_inspection.json").read_text())["num_valid_samples"] == 2 and json.loads((tmp_path / "out/reference_summary.json").read_text())["generator_summary"] == {"flag": {"prepared": 2, "failed": 0, "coverage_ratio": 1.0}}
    assert "status: success" in (tmp_path / "out/logs/run.log").read_text()
    assert runner.manifest_to_use("raw.json", str(tmp_path / "none.json")) == "raw.json" and runner.manifest_to_use("raw.json", manifest_path) == manifest_path
    assert (tmp_path / "out/metrics.json").read_text().endswith("}\n")
    sinks.enveloped(spark.createDataFrame([(1, "é")], "i int, t string"), {"n": 1, "samples": []}, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"n": 1, "samples": [{"i": 1, "t": "é"}]} and "é" in (tmp_path / "e.json").read_text()


def test_encoder_is_pluggable(spark):
    frames = spark.createDataFrame([(i, bytes([i])) for i in range(5)], "i int, frame binary")
    out = registry.encoded(frames, lambda: lambda rows: [[float(r[0]), 1.0] for r in rows], batch=2)
    assert {r.i: r.feature for r in out.collect()} == {i: [float(i), 1.0] for i in range(5)}


def test_mosaic_and_target_status(spark):
    rows = [("s", v, 1, 2, 0, x, 10 * i + x) for i, v in enumerate(VIEWS) for x in range(2)] + [("t", VIEWS[0], 1, 1, 0, 0, 1)]
    out = visual.mosaic(spark.createDataFrame(rows, "sample_id string, view string, h int, w int, y int, x int, value int")).collect()
    grid = np.zeros((2, 6), int)
    for r in out:
        grid[r.y, r.x] = r.value
    assert len(out) == 12 and grid.tolist() == [[0, 1, 10, 11, 20, 21], [30, 31, 40, 41, 50, 51]]
    parts = spark.createDataFrame([("a", 0, "success", None), ("a", 1, "skipped", "r1"), ("b", 0, "partial", "r0"), ("b", 1, "skipped", "r1"), ("c", 0, "skipped", None)], "sample_id string, part int, status string, reason string")
    assert {r.sample_id: (r.status, r.reason) for r in visual.target_status_of_parts(parts).collect()} == {"a": ("success", "r1"), "b": ("partial", "r0"), "c": ("skipped", None)}


def test_a_mosaic_does_not_broadcast_pixels(spark):
    tiles = spark.range(12).select(F.expr("CAST(id div 6 AS string)").alias("sample_id"), F.element_at(F.array(*map(F.lit, VIEWS)), (F.col("id") % 6 + 1).cast("int")).alias("view"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("id").alias("value"))
    for axis in ("y", "x"):
        tiles = tiles.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = visual.mosaic(tiles)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2 * 6 * 64 == out.select("sample_id", "y", "x").distinct().count()


def test_reports_of_any_length_are_read_and_written_by_pieces(spark, tmp_path, monkeypatch):
    rows = [{"s": f"é\n \"{i}", "v": None if i % 3 else f"{i}"} for i in range(25)]
    whole = {"n": 12, "rows": rows, "deep": {"rows": [1]}, "last": 1.5e3}
    for shown in (json.dumps(whole, indent=2, ensure_ascii=False), json.dumps(whole)):
        data = shown.encode()
        for size in (1, 7, 1 << 20):
            found = list(manifest.entries((data[i : i + size] for i in range(0, len(data), size)), "rows"))
            assert found == [("n", 12), *(("rows", r) for r in rows), ("deep", {"rows": [1]}), ("last", 1500.0)]
    assert list(manifest.entries([b'{"rows": [], "a": [1]} '], "rows")) == [("a", [1])] and not list(manifest.entries([b"{}"], "rows"))
    for bad in (b"", b"[1]", b'{"rows": [1', b'{"rows": [1}', b'{"a": 1} 2', b'{"a" 1}'):
        with pytest.raises(ValueError):
            list(manifest.entries([bad], "rows"))
    monkeypatch.setattr(sinks, "CHUNK", 50)
    monkeypatch.setattr(sinks, "RENDERED", 4)
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/scheme"):
        df = spark.createDataFrame(rows, "s string, v string").coalesce(1)
        sinks.write_frame(f"{root}/r.json", {"n": 12}, "rows", df)
        sinks.write_rows(f"{root}/same.json", {"n": 12}, "rows", rows)
        assert b"".join(sinks.read_chunks(f"{root}/r.json")) == b"".join(sinks.read_chunks(f"{root}/same.json"))
        head, read = manifest.read_report(spark, f"{root}/r.json", "rows", "s string, v string", f"{root}/read")
        assert head == {"n": 12} and sorted(map(tuple, read.collect())) == sorted((r["s"], r["v"]) for r in rows)


def test_the_list_of_failed_samples_is_not_one_value(spark, tmp_path, monkeypatch):
    from framelens.queries import base, roundtrips

    spark.range(700).selectExpr("id AS o_orderkey", "IF(id % 2 = 0, '5-LOW', '1-URGENT') AS o_orderpriority", "id * 1.5D AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    read = manifest.read_payload
    monkeypatch.setattr(roundtrips.manifest, "read_payload", lambda s, path: read(s, path).where(F.octet_length(F.to_json("payload")) < 20_000))
    out = base.QUERIES["SNK5"](spark, str(tmp_path)).groupBy("kind").count().collect()
    assert {r[0]: r[1] for r in out} == {"summary": 2, "failed metric": 1, "failed sample": 350 + 350 // 7 + 27}


def test_scores_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    kind = "sample_id string, view string, frame_index int, feature array<double>"
    spark.createDataFrame([("s", "v", t, [float(x) for x in rng.normal(size=3)]) for t in range(4)], kind).write.parquet(str(tmp_path / "in"))
    got = []
    score_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, i: got.extend(df.collect())).awaitTermination(60)
    assert len(got) == 1 and got[0].n_frames == 4 and 0 <= got[0].score <= 1


def test_the_library_does_not_import_the_training_data_operators():
    from pathlib import Path

    import framelens

    root = Path(framelens.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"framelens\.llm|from \.llm", p.read_text())]


def test_reports_to_a_path_with_a_scheme(spark, tmp_path):
    sinks.write_report(f"file://{tmp_path}/deep/r.json", {"é": [1]})
    sinks.write_report(f"{tmp_path}/plain/r.json", {"é": [1]})
    assert (tmp_path / "deep/r.json").read_bytes() == (tmp_path / "plain/r.json").read_bytes() == '{\n  "é": [\n    1\n  ]\n}\n'.encode()
