"""From manifests to reports: metadata as facts, configuration, failures, envelopes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import enrich, facts, instances, semantic
from framelens.plans import registry, runner
from framelens.schema import CAMERA_PAIRS, VIEWS
from framelens.sources import manifest, sinks

A, B = VIEWS[:2]


def samples_of(spark, metadata):
    rows = [(k, json.dumps(v)) for k, v in metadata.items()]
    return spark.createDataFrame(rows, "sample_id string, m string").select("sample_id", F.parse_json("m").alias("metadata"))


def found(df):
    return {r.sample_id: (r.status, None if r.score is None else round(r.score, 6), r.reason) for r in df.collect()}


def coherence_of(f):
    f = np.asarray(f, float)
    f = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-8)
    acm = np.clip((f[1:] * f[:-1]).sum(axis=1), 0, 1).mean()
    if len(f) < 3:
        return acm
    v = np.linalg.norm(f[1:] - f[:-1], axis=1)
    return acm / (1 + (np.linalg.norm(f[2:] - 2 * f[1:-1] + f[:-2], axis=1) / (0.5 * (v[1:] + v[:-1]) + 1e-8)).mean())


def test_coherence_from_metadata(spark):
    rng = np.random.default_rng(1)
    one, two, cube = rng.normal(size=(4, 3)).tolist(), rng.normal(size=(2, 3)).tolist(), rng.normal(size=(3, 2, 2)).tolist()
    meta = {
        "views": {"object_features": {A: {"x": one, "y": two, "short": [[1, 2]], "flat": [1, 2], "null": None, "holes": [[1, None], [1, 2]]}, B: {"x": cube}, "other": {"x": two}}},
        "older": {"object_features": {"x": one, "y": two}},
        "ragged": {"object_features": {A: {"x": [[1, 2], [3]], "y": one}}},
        "unscored": {"object_features": {A: {"x": [[1, 2]]}}},
        "words": {"object_features": {"x": ["a", "b"]}},
        "none": {"object_features": {}},
        "list": {"object_features": [1]},
        "short": {"object_features": {"x": [[1, 2]]}},
    }
    out = found(facts.coherence_outcomes(samples_of(spark, meta)))
    by_view = np.mean([np.mean([coherence_of(one), coherence_of(two)]), coherence_of(np.reshape(cube, (3, 4)))])
    assert out["views"][:2] == ("success", round(by_view, 6)) and out["older"][:2] == ("success", round(np.mean([coherence_of(one), coherence_of(two)]), 6))
    assert out["ragged"][0] == "failed" and out["ragged"][2].startswith("ValueError") and out["words"][0] == "failed"
    assert out["unscored"][0] == "failed" and out["unscored"][2].startswith("TypeError")
    assert out["none"] == out["list"] == ("skipped", None, "metadata['object_features'] must be a non-empty dict.")
    assert out["short"] == ("skipped", None, "No usable object feature sequence found in metadata['object_features'].")


def test_signals_of_raw_values():
    both = facts.signals
    assert both([{"car": 0.9, "bus": 0.1}, {"car": 0.2, "bus": 0.8}, {"label": "car", "confidence": 0.5}], ["x"]) == (2 / 3, pytest.approx(np.mean([0.9, 0.8, 0.5]) / (1 + np.std([0.9, 0.8, 0.5]))))
    assert both({"car": 0.9, "truck": 0.1}, ["a", "a"]) == (None, pytest.approx(0.5 / 1.4))  # values are observations, and identities aren't asked
    assert both(None, ["a", "a", "b", None]) == (2 / 3, None) and both(None, "a") == (1.0, None) and both(None, [None]) == (None, None) and both(None, {"a": 1}) == (None, None)
    assert both([{"car": "0.9", "bus": 0.2}], None) == (1.0, 0.2) and both([{"label": None}], None) == (1.0, None)
    assert both(0.7, None) == (None, 0.7) and both("bus", None) == (1.0, None) and both([[0.5, [2]], {"score": 0.25, "x": 0.9}], None)[1] == pytest.approx(np.mean([0.5, 1, 0.25]) / (1 + np.std([0.5, 1, 0.25])))
    assert both([], ["a"]) == (None, None) and both([{"confidence": True}], None) == (1.0, 1.0)


def test_tracks_from_metadata(spark):
    box = lambda t, *b: {"frame_index": t, "bbox": list(b)}
    meta = {
        "a": {
            "instance_tracks": {A: [{"object_id": "1", "boxes": [box(0, 0, 0, 1, 1)], "class_scores": [], "attributes": {"k": 1, "m": 1}}, {"category": "x", "identities": ["p"]}, {"object_id": "gone"}, 5]},
            "object_tracks": {A: [{"object_id": "1", "boxes_2d": [box(1, 0, 0, 1, 1)], "class_scores": [{"car": 1.0}], "attributes": {"k": 2}}]},
            "objects": {A: [{"object_id": 0, "identities": ["q", "q"]}]},
            "object_class_scores": {A: {"1": [{"bus": 0.5}], "new": [{"bus": 0.5}]}},
            "object_crops": {A: {"1": ["c.png"], "crop only": ["d.png"]}},
        },
        "b": {"instance_tracks": [{"object_id": "z", "identities": ["q"]}], "object_identities": {"z": ["r", "s"], "y": "one"}},
    }
    df = samples_of(spark, meta)
    got = {(r.sample_id, r.view, r.object_id): r for r in facts.tracks(df).collect()}
    assert set(got) == {("a", A, k) for k in ("1", "track_0", "track_1", "new")}
    one = got["a", A, "1"]
    assert [b.frame_index for b in one.boxes] == [0, 1] and json.loads(one.class_scores) == [{"bus": 0.5}] and one.attributes == {"k": "2", "m": "1"} and json.loads(one.crops) == ["c.png"]
    assert json.loads(got["a", A, "track_0"].identities) == ["p"] and json.loads(got["a", A, "track_1"].identities) == ["q", "q"]
    older = {r.object_id: json.loads(r.identities) for r in facts.tracks(df, by_view=False).where("sample_id = 'b'").collect()}
    assert older == {"z": ["r", "s"], "y": "one"}


def test_consistency_from_metadata_with_weights(spark):
    boxes = [{"frame_index": t, "bbox": [0, 0, 2, 2]} for t in range(3)]
    meta = {
        "full": {"instance_tracks": {A: [{"object_id": "1", "boxes": boxes, "class_scores": ["car", "car"]}]}, "num_frames": 6},
        "older": {"instance_tracks": [{"object_id": "1", "identities": ["a", "b"]}]},
        "void": {"instance_tracks": {A: [{"object_id": "1", "boxes": boxes}]}, "num_frames": None},
        "nothing": {"instance_tracks": {A: [{"object_id": "1"}]}},
        "blind": {"instance_tracks": {A: [{"object_id": "1", "boxes": boxes[:1]}]}},
        "older blind": {"instance_tracks": [{"object_id": "1", "boxes": boxes[:1]}]},
    }
    out = found(facts.consistency_outcomes(samples_of(spark, meta), {"class_weight": 0.5, "confidence_weight": 0.1, "geometry_weight": 0.4}))
    geometry = 0.35 + 0.2 + 0.2 + 0.15 + 0.1 * 0.5
    assert out["full"][:2] == ("success", round(0.5 + 0.4 * geometry, 6)) and out["older"][:2] == ("success", 0.25)
    assert out["void"][0] == "failed" and out["nothing"][2].startswith("No usable prepared tracks") and out["blind"][2] == out["nothing"][2]
    assert out["older blind"] == ("skipped", None, "No usable track-level signals were available for scoring.")


def test_masks_from_metadata(spark):
    rng = np.random.default_rng(2)
    m, n = rng.integers(0, 3, (3, 4, 5)), rng.integers(0, 2, (2, 3, 3))
    meta = {
        "views": {"semantic_masks": {A: m.tolist(), B: "m.npy", VIEWS[2]: "gone.npy", VIEWS[3]: [1]}, "semantic_num_classes": {A: 3}},
        "older": {"semantic_masks": n.tolist(), "semantic_num_classes": 2},
        "label": {"semantic_masks": {A: m.tolist()}, "semantic_ignore_label": 7},
        "ragged": {"semantic_masks": {A: [[[1], [1, 2]]]}},
        "empty": {"semantic_masks": {A: np.full((2, 2, 2), -1).tolist(), B: m.tolist()}},
        "none": {},
    }
    tensors = spark.createDataFrame([("m.npy", t, 3, 3, [int(x) for x in f.ravel()]) for t, f in enumerate(n)], "path string, t int, h int, w int, values array<int>")
    df = samples_of(spark, meta)
    out = found(facts.semantic_outcomes(df, {"min_iou": 0.3}, tensors=tensors))

    def score(x, k):
        frames = [semantic.Frame(f, k) for f in x]
        pairs = list(zip(frames, frames[1:]))
        mean = lambda v: np.mean(v) if len(v) else 0.0
        flips, js = [f for a, b in pairs if (f := a.flips(b)) is not None], [j for a, b in pairs if (j := a.shift(b)) is not None]
        hit, area = np.sum([a.matched(b, 0.3) for a, b in pairs], axis=0)
        return 0.5 * (1 - mean(flips)) + 0.4 * hit / (area + 1e-8) + 0.1 * (1 - mean(js))

    assert out["views"][:2] == ("success", pytest.approx((score(m, 3) + score(n, int(n.max()) + 1)) / 2, abs=1e-6))
    assert out["older"][:2] == ("success", pytest.approx(score(n, 2), abs=1e-6)) and out["label"][0] == out["none"][0] == "skipped"
    assert out["ragged"][0] == "failed" and out["empty"] == ("failed", None, "ValueError: num_classes must be positive after ignoring invalid pixels.")


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_interior_is_where_the_footprint_has_one_class(k):
    m = np.kron(np.random.default_rng(3).integers(0, 2, (4, 4)), np.ones((3, 3), int))
    inside = semantic.Frame(m, 2, erosion=k).inside
    for y in range(12):
        for x in range(12):
            part = m[max(0, y - k // 2) : y + k - k // 2, max(0, x - k // 2) : x + k - k // 2]
            assert inside[y, x] == (part == m[y, x]).all()


def test_patches_join_metadata():
    merged = json.loads(enrich.merged_json('{"a": {"x": 1, "y": 1}, "b": 2}', [{"a": '{"y": 2}', "c": "plain"}, {"b": '{"z": 3}'}]))
    assert merged == {"a": {"x": 1, "y": 2}, "b": {"z": 3}, "c": "plain"} and json.loads(enrich.merged_json(None, [])) == {}


def write_manifest(path, records):
    path.write_text(json.dumps({"samples": records}))
    return str(path)


FULL = {v: f"{v}.mp4" for v in VIEWS}


@pytest.fixture
def generators(monkeypatch):
    def depth(samples, config):
        bad = F.col("sample_id") == "bad"
        tracks = F.lit(json.dumps({A: [{"object_id": "1", "class_scores": ["car", "car", "bus"]}]}))
        patch = F.when(F.col("sample_id") == "rude", F.create_map(F.lit("camera_videos"), F.lit("{}"))).otherwise(F.create_map(F.lit("instance_tracks"), tracks))
        return samples.select("sample_id", F.lit("tracks").alias("generator"), F.lit(0).alias("rank"), F.when(~bad, patch).alias("patch"), F.when(bad, "ValueError: no tracks").alias("error"))

    monkeypatch.setitem(registry.GENERATORS, "tracks", depth)
    monkeypatch.setitem(registry.METRICS, "broken", lambda s, t, c: t["missing"])


def test_a_run_from_manifest_to_reports(spark, tmp_path, generators):
    records = [{"sample_id": s, "metadata": {"camera_videos": FULL}} for s in ("ok", "ok", "bad", "rude")] + [{"sample_id": "no"}]
    path = write_manifest(tmp_path / "real_4_20240101.json", records)
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([("ok", A, t, [float(x) for x in rng.normal(size=3)]) for t in range(3)], "sample_id string, view string, t int, feature array<double>")
    matches = spark.createDataFrame([(s, p[0], p[1], 0, [0.5] * 5) for s in ("ok", "bad") for p in CAMERA_PAIRS], "sample_id string, cam_a string, cam_b string, t int, mconf array<double>")
    pixels = spark.createDataFrame([("ok", A, 0, 0, 0, 1.0), ("ok", A, 0, 0, 1, 2.0)], "sample_id string, view string, t int, y int, x int, depth double")
    config = {
        "stage": "all", "continue_on_error": True, "generators": {"tracks": {}}, "profile": "p", "profiles": {"p": {"runtime": {"num_shards": 3}}},
        "metrics": {"instance_consistency": {"enabled": True, "metric": {"class_weight": 0.9}}, "depth_consistency": {"enabled": True, "model": {"depth_l2_scale": 0.1}}, "view_consistency": {"enabled": True, "metric": {"match_count_ref": 10}}, "broken": {"enabled": True}, "temporal_consistency": {}},
        "visualizers": {"depth_first_frame": {"enabled": True}, "mosaic": {"enabled": True}},
    }
    out = tmp_path / "out"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert runner.run(spark, path, {"video_embeddings": e, "matches": matches, "depth_pixels": pixels}, config, str(out)) == "failed"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    read = lambda name: json.loads((out / name).read_text())
    seen = read("data_inspection.json")
    assert (seen["num_samples"], seen["num_valid_samples"], seen["file_exists"], seen["samples_format_valid"]) == (5, 4, True, True) and [x["sample_id"] for x in seen["invalid_samples"]] == ["no"]
    ref = read("reference_summary.json")
    assert (ref["dataset_name"], ref["data_count"], ref["timestamp"], ref["num_samples"], ref["failed_sample_count"]) == ("real", 4, "20240101", 4, 2)
    assert {x["sample_id"]: x["errors"][0]["reason"] for x in ref["failed_samples"]} == {"bad": "ValueError: no tracks", "rude": "ValueError: Reference generators must not overwrite protected metadata key: camera_videos"}
    enriched = {r["index"]: json.loads(r.record) for r in spark.read.parquet(str(out / "enriched_data")).collect()}
    assert len(enriched) == 5 and "instance_tracks" in enriched[0]["metadata"] and "instance_tracks" in enriched[1]["metadata"] and "instance_tracks" not in enriched[2]["metadata"] and enriched[0]["metadata"]["camera_videos"] == FULL
    metrics = read("metrics.json")
    assert (metrics["dataset_name"], metrics["data_count"], metrics["num_samples"]) == ("real", 4, 4) and metrics["data_file"].endswith("enriched_data/")
    results = metrics["results"]
    assert results["instance_consistency"]["mean_instance_consistency_score"] == pytest.approx(0.9 * 2 / 3) and results["instance_consistency"]["skipped_sample_count"] == 2
    assert results["view_consistency"]["mean_view_consistency_score"] == pytest.approx(0.25)
    l2 = np.linalg.norm(np.diff(np.array([r.feature for r in e.orderBy("t").collect()]), axis=0), axis=1).mean()
    assert results["depth_consistency"]["mean_depth_consistency_score"] == pytest.approx(math.exp(-0.1 * l2))
    assert results["broken"]["status"] == "failed" and results["broken"]["reason"].startswith("KeyError") and "temporal_consistency" not in results
    summary = read("summary.json")
    assert summary["summary"]["depth_consistency"]["status"] == "success" and list(summary["summary"]["_failed_metrics"]) == ["broken"] and summary["output_dir"] == str(out)
    assert {(x["metric"], x["sample_id"]) for x in read("failed_samples.json")["failed_samples"]} >= {("instance_consistency", "bad"), ("view_consistency", "rude")}
    assert {x["target"]: x["status"] for x in read("visualization_summary.json")} == {"depth_first_frame": "success", "mosaic": "skipped"}
    assert spark.read.parquet(str(out / "visualizations/depth_first_frame")).count() == 2


def test_a_failing_generator_stops_the_run_unless_told_otherwise(spark, tmp_path, generators):
    path = write_manifest(tmp_path / "m.json", [{"sample_id": "bad", "metadata": {"camera_videos": FULL}}])
    with pytest.raises(RuntimeError, match="sample=bad, generator=tracks"):
        runner.run(spark, path, {}, {"stage": "prepare_reference", "generators": {"tracks": {}}}, str(tmp_path / "out"))


def test_inspection_of_files_that_are_no_manifests(spark, tmp_path):
    (tmp_path / "shape.json").write_text('{"a": 1}')
    (tmp_path / "text.json").write_text("nothing")
    for name, error in (("none.json", "Data file does not exist"), ("shape.json", "ValueError: Data JSON must be"), ("text.json", "ValueError")):
        report, invalid = manifest.inspect_file(spark, str(tmp_path / name))
        assert report["error"].startswith(error) and invalid is None and report["num_samples"] == 0


def test_reports_written_row_by_row_are_like_others(tmp_path):
    rows = [{"é": [1, {"a": None}]}, "x", []]
    for head, items in ((None, rows), ({"n": {"m": 1}}, rows), ({"n": 1}, []), (None, [])):
        sinks.write_rows(str(tmp_path / "r.json"), head, "rows", items)
        whole = items if head is None else head | {"rows": items}
        assert (tmp_path / "r.json").read_text() == json.dumps(whole, ensure_ascii=False, indent=2) + "\n"


def test_a_run_in_a_folder_with_a_scheme(spark, tmp_path):
    path = write_manifest(tmp_path / "m.json", [{"sample_id": "a", "metadata": {"camera_videos": FULL}}])
    matches = spark.createDataFrame([("a", p[0], p[1], 0, [1.0] * 50) for p in CAMERA_PAIRS], "sample_id string, cam_a string, cam_b string, t int, mconf array<double>")
    config = {"metrics": {"view_consistency": {"enabled": True}}, "dataset_name": "d"}
    assert runner.run(spark, f"file://{path}", {"matches": matches}, config, f"file://{tmp_path}/out") == "success"
    assert json.loads((tmp_path / "out/summary.json").read_text())["summary"]["view_consistency"]["mean_view_consistency_score"] == 1.0
    assert "status: success" in (tmp_path / "out/logs/run.log").read_text()


def test_models_for_clips_and_pairs(spark):
    frames = spark.createDataFrame([("s", "v", t, bytes([t])) for t in (2, 0, 1)], "sample_id string, view string, t int, frame binary")
    model = lambda: lambda rows: [{"t": i, "h": 1, "w": 1, "depth": [float(b[0])]} for i, b in enumerate(rows)]
    assert sorted((r.t, r.depth) for r in registry.clip_depths(frames, model).collect()) == [(0, [0.0]), (1, [1.0]), (2, [2.0])]
    pairs = spark.createDataFrame([("s", "a", "b", 0, b"xy", b"xz")], "sample_id string, cam_a string, cam_b string, t int, frame_a binary, frame_b binary")
    match = lambda: lambda two: [{"mconf": [float(p == q) for p, q in zip(*two)]}]
    assert registry.pair_matches(pairs, match).first().mconf == [1.0, 0.0]


def test_weights_of_ready_tables(spark):
    kind = "sample_id string, view string, object_id string"
    labels = spark.createDataFrame([("s", "v", "o", "a", 0.5)], f"{kind}, label string, confidence double")
    boxes = spark.createDataFrame([("s", "v", "o", 0, 0, [0.0, 0.0, 1.0, 1.0])], f"{kind}, frame_index int, position int, bbox array<double>")
    assert instances.scored_tracks(labels, boxes, {"class_weight": 0.2, "confidence_weight": 0.6}).first().score == pytest.approx(0.2 + 0.3)


def test_images(spark, tmp_path):
    from framelens.sources import files

    rng = np.random.default_rng(5)
    for shape in ((3, 5), (2, 4, 3)):
        values = rng.integers(0, 256, shape)
        assert (files.png_pixels(sinks.png(values)) == values).all()
    df = spark.createDataFrame([("a", 2, 2, [0, 50, 300, 255])], "name string, h int, w int, values array<int>")
    sinks.write_images(sinks.encoded_images(df), str(tmp_path / "local"))
    sinks.write_images(sinks.encoded_images(df), f"file://{tmp_path}/remote")
    assert (tmp_path / "local/a.png").read_bytes() == (tmp_path / "remote/a.png").read_bytes()
    assert files.png_pixels((tmp_path / "local/a.png").read_bytes()).tolist() == [[0, 50], [255, 255]]


def test_a_running_score_is_that_of_the_whole_clip():
    from framelens.streaming.incremental import advanced, score_of

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 11):
        f = rng.normal(size=(n, 3))
        for cuts in ([n], [1] * n, [1, n - 1] if n > 1 else [1], [n // 2, n - n // 2] if n > 1 else [1]):
            state, at = (0, True, [], 0.0, 0.0, 0.0), 0
            for c in cuts:
                state = advanced(state, f[at : at + c])
                at += c
            assert state[0] == n and (score_of(state)[2] is None if n < 2 else score_of(state)[2] == pytest.approx(coherence_of(f)))
    assert score_of(advanced((2, True, [1.0, 0.0, 1.0, 0.0], 0.0, 1.0, 0.0), np.array([[np.nan, 0.0]]))) == (None, None, None)


def test_tagged_indexes_and_short_clips(spark):
    df = spark.createDataFrame([('{"a": [1, 2], "b": 3}',)], "j string").select(F.parse_json("j").alias("payload"))
    found = df.select(F.explode(manifest.tagged_items(F.col("payload"))).alias("e")).select("e.key", F.to_json("e.value").alias("v")).collect()
    assert {r.key: r.v for r in found} == {"a": "[1,2]", "b": "3"}
    clips = spark.createDataFrame([("s", "v", 1), ("s", "w", 2)], "sample_id string, view string, n_frames int")
    assert {r.view: r.error for r in enrich.with_frame_guard(clips).collect()} == {"v": "at least two frames are required", "w": None}
