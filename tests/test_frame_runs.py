"""Whole frames: payloads with settings of their own in one job, batches, mask encodings, layouts and smoothing."""

import json

import pytest
from pyspark.sql import functions as F

from framemill import tables as T
from framemill.plans import frames as R
from framemill.sources import payload as P

SQUARE = [[10, 10, 30, 10, 30, 30, 10, 30]]
SIZE = {"width": 64, "height": 48}


def item(score=0.9, label="a", **more):
    return {"score": score, "label": label, **more}


def pose(dx=0.0, score=0.9, **more):
    return item(score, None, keypoints=[[20 + dx + 3 * (i % 4), 10 + 2 * i, 0.9] for i in range(17)], **more)


def seg(*items, image=SIZE, **params):
    return {"task": "segmentation", "image": image, "predictions": list(items), "params": params}


def poses(*items, **params):
    return {"task": "pose", "image": SIZE, "predictions": list(items), "params": params}


FRAMES = {
    "suppress": seg(item(0.9, segmentation=SQUARE), item(0.8, segmentation=SQUARE), item(0.7, "b", segmentation=SQUARE), item(0.1)),
    "merge": seg(item(0.5, segmentation=SQUARE, zone="x"), item(0.9, segmentation=[[40, 10, 50, 10, 50, 20, 40, 20]]), merge_same_label=True, output_mask="both"),
    "area": seg(item(segmentation=SQUARE), item(0.8, segmentation=[[1, 1, 4, 1, 4, 4, 1, 4]]), item(0.7, bbox=[1, 2, 3, 4]), min_area=50, require_mask=True),
    "broken": seg(item(segmentation={"counts": "abc"}), item(0.8, "b", mask="?", bbox=[1, 2, 9, 9]), image=None),
    "scaled": {"task": "segmentation", "orig_shape": [100, 200], "predictions": [item(bbox=[0.1, 0.2, 0.5, 0.6])]},
    "mixed": seg(item(bbox=[10, 10, 5, 5]), item(0.8, "b", bbox=[10, 10, 25, 25])),
    "wrong": seg(item(), confidence_threshold=5.0),
    "pose": poses(pose(), pose(0.5, 0.8), pose(30, 0.7, track_id=4), compute_angles=True, include_skeleton=False),
    "layout": poses(item(keypoints=[1, 2, 0.9, 3, 4, 0.9, 5, 6, 0.9]), layout={"name": "tri", "names": ["p", "q"], "sigmas": [0.1], "skeleton": [[0, 1]]}),
    "smooth": {**poses(pose(10, track_id=7), pose(40, 0.8), smoothing={"enabled": True, "alpha": 0.5}), "previous": {"instances": [{"track_id": 7, "keypoints": pose(0)["keypoints"]}, {"keypoints": pose(41)["keypoints"]}]}},
    "alone": poses(pose(), smoothing={"enabled": True}),
    "list": [item(bbox=[1, 2, 3, 4])],
    "numbers": [1, 2, 3],
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in FRAMES.items()], "frame_key string, payload string")
    return {r.frame_key: (r.status_code, r.response and json.loads(r.response)) for r in R.run(df).collect()}


def test_status(got):
    assert set(got) == set(FRAMES)
    assert {k: v[0] for k, v in got.items() if v[0] != 200} == {"wrong": 422, "numbers": 422, "list": 400}


def test_segmentation(got):
    r = got["suppress"][1]
    assert [i["source_index"] for i in r["instances"]] == [0, 2] and r["instances"] == r["detections"]
    assert r["stats"]["suppressed_by_nms"] == 1 and r["stats"]["dropped_low_confidence"] == 1 and r["stats"]["kept"] == 2 and r["stats"]["nms_similarity"] == "mask_iou"
    assert r["instances"][0]["area"] == 400 and r["instances"][0]["bbox"] == [10, 10, 30, 30] and len(r["instances"][0]["mask"]["polygons"][0]) == 8
    (m,) = got["merge"][1]["instances"]
    assert (m["source_index"], m["area"], m["bbox"], m["merged_from"], m["mask"]["format"]) == (1, 500, [10, 10, 50, 30], 2, "polygon+rle") and sum(m["mask"]["rle"]["counts"]) == 64 * 48
    r = got["area"][1]
    assert [i["source_index"] for i in r["instances"]] == [0] and (r["stats"]["dropped_by_area"], r["stats"]["dropped_no_mask"]) == (1, 1)


def test_warnings_and_sizes(got):
    r = got["broken"][1]
    assert r["image"] == {"width": 10, "height": 10} and r["count"] == 2
    assert r["warnings"] == ["image size not supplied; inferred 10x10 from prediction extents. Send image.width / image.height for exact mask rasterisation.", "instance 0: mask decode failed", "2 instance(s) had a mask field that could not be decoded"]
    r = got["scaled"][1]
    assert r["image"] == {"width": 200, "height": 100} and r["instances"][0]["bbox"] == [20, 20, 100, 60] and "scaled" in r["warnings"][0]
    assert "mixed bbox formats" in got["mixed"][1]["warnings"][0] and got["mixed"][1]["instances"][0]["bbox"] == [10, 10, 15, 15]


def test_poses(got):
    r = got["pose"][1]
    assert [i["source_index"] for i in r["instances"]] == [0, 2] and "skeleton" not in r["keypoint_layout"] and r["instances"][1]["track_id"] == 4
    assert len(r["instances"][0]["keypoints"]) == 17 and len(r["instances"][0]["keypoints_flat"]) == 51 and r["instances"][0]["keypoints"][0]["name"] == "nose" and "left_elbow" in r["instances"][0]["angles"]
    r = got["layout"][1]
    assert [k["name"] for k in r["instances"][0]["keypoints"]] == ["p", "q", "kp_2"] and "model emitted 3 keypoints" in r["warnings"][0]


def test_smoothing(got):
    r = got["smooth"][1]
    assert r["stats"]["smoothed"] == 2 and [i["keypoints"][0]["x"] for i in r["instances"]] == [25.0, 60.5]
    assert "no usable 'previous'" in got["alone"][1]["warnings"][0]


def test_batches(spark):
    rows = [(1, json.dumps({"items": [seg(item(bbox=[1, 2, 9, 9])), {"nothing": "useful"}], "params": {"confidence_threshold": 0.95}, "task": "segmentation"})), (2, "[]"), (3, '{"items": []}'), (4, json.dumps([{}] * 65)), (5, "{bad")]
    items, batches = R.run_batches(spark.createDataFrame(rows, "batch_key long, body string"))
    assert sorted((r.batch_key, r.status_code, r["count"], r.failed) for r in batches.collect()) == [(1, 200, 2, 1), (2, 200, 0, 0), (3, 400, 0, 0), (4, 413, 0, 0), (5, 400, 0, 0)]
    assert sorted((r["index"], r.status_code, r.n_instances) for r in items.collect()) == [(0, 200, 0), (1, 422, 0)]


SIZES = [({"image": {"width": 3, "height": 4}}, (3, 4)), ({"orig_shape": [4, 3]}, (3, 4)), ({"img_width": "3", "frame_height": 4}, (3, 4)), ({"shape": [4, 3, 3]}, (3, 4)), ({"image": {"width": 0, "height": 4}}, None), ({"image": {"W": 3.9, "H": 4}}, (3, 4)), ({"image": {"width": 0, "height": 4}, "meta": {"w": 5, "h": 6}}, (5, 6)), ({"image": {"width": 10**12, "height": 5}}, 422), ({"image": {"width": -3, "height": 5}}, 422), ({"image": {"width": "x", "height": 5}}, None)]


def test_sizes(spark):
    df = spark.createDataFrame([(i, json.dumps({**v, "predictions": []})) for i, (v, _) in enumerate(SIZES)], "frame_key long, payload string")
    got = {r.frame_key: r for r in P.read_frames(df).collect()}
    assert [got[i].status_code if got[i].error else got[i].image_width and (got[i].image_width, got[i].image_height) for i in range(len(SIZES))] == [w for _, w in SIZES]


ODD = {
    "nan": '{"predictions":[{"score":NaN}]}', "twice": '{"predictions":[],"predictions":[]}', "behind": '{"predictions":[]} x', "huge": '{"image":{"width":1000000000000,"height":5},"predictions":[]}',
    "corner": '{"predictions":[{"bbox":["a",2,5,8]},{"bbox":[1,2,5,8]}]}', "hole": '{"predictions":[{"bbox":[null,2,5,8]}]}', "fine": '{"frame_id":42,"timestamp":"2026-08-13T10:00:00Z","camera_id":null,"predictions":[{"bbox":[1,2,50,80],"track_id":"7","label":true,"class_id":2.7}]}',
    "params": '{"predictions":[],"params":{"confidence_threshold":"x","max_detections":2.5,"nms":"oks","fill_holes":"maybe","denied_labels":[1],"min_area":-1,"unknown":1}}', "loose": '{"predictions":[],"params":{"confidence_threshold":"0.5","fill_holes":"true","min_area":null}}',
}


def test_odd_frames_fail_alone(spark):
    df = spark.createDataFrame(list(ODD.items()), "frame_key string, payload string")
    got = {r.frame_key: r for r in R.run(df, task="segmentation").collect()}
    assert {k: r.status_code for k, r in got.items()} == {"nan": 400, "twice": 400, "behind": 400, "huge": 422, "corner": 500, "hole": 500, "fine": 200, "params": 422, "loose": 200}
    assert got["corner"].error == "instance 0: a coordinate is no number"
    fine = json.loads(got["fine"].response)
    assert (fine["frame_id"], fine["timestamp"]) == (42, "2026-08-13T10:00:00Z") and fine["instances"][0]["track_id"] == "7" and (fine["instances"][0]["label"], fine["instances"][0]["label_id"]) == ("True", 2)
    wrong = json.loads(got["params"].error.removeprefix("invalid parameters: "))
    assert {w["param"]: w["received"] for w in wrong} == {"confidence_threshold": "'x'", "max_detections": "2.5", "nms": "'oks'", "fill_holes": "'maybe'", "denied_labels": "[1]", "min_area": "-1"}
    assert {w["param"]: w["message"] for w in wrong}["nms"] == "Input should be 'mask', 'box' or 'none'"
    loose = json.loads(got["loose"].response)["params"]
    assert (loose["confidence_threshold"], loose["fill_holes"], loose["min_area"]) == (0.5, True, 0)


def test_smoothing_forbids_unknown_keys(spark):
    rows = [("more", {"enabled": True, "beta": 1}), ("jump", {"max_jump": 0}), ("text", "on"), ("fine", {"max_jump": 3})]
    df = spark.createDataFrame([(k, json.dumps({"poses": [], "params": {"smoothing": v}})) for k, v in rows], "frame_key string, payload string")
    got = {r.frame_key: (r.status_code, r.error) for r in R.run(df, task="pose").collect()}
    assert {k: v[0] for k, v in got.items()} == {"more": 422, "jump": 422, "text": 422, "fine": 200}
    assert json.loads(got["more"][1].removeprefix("invalid parameters: ")) == [{"param": "smoothing.beta", "message": "Extra inputs are not permitted", "received": "1"}]


def test_large_tables_of_like_rows_are_not_gathered(spark):
    """A megabyte of files may be a gigabyte of rows: joins of saved frames don't send them through the driver."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("frame_key"), F.repeat(F.lit("x"), F.lit(1000)).alias("p"))
    few, many = R.saved(rows(100), "few"), R.saved(rows(T.MANY + 1), "many")
    other = spark.range(3_000_000).select(F.col("id").cast("string").alias("frame_key"))
    assert "BroadcastHashJoin" in plan(other.join(few, "frame_key"))
    for join in (other.join(many, "frame_key"), other.join(many.groupBy("frame_key").agg(F.max("p")), "frame_key", "left")):
        assert "Broadcast" not in plan(join)


def test_runs_without_broadcasts_are_the_same(spark, got, monkeypatch):
    monkeypatch.setattr(T, "MANY", 0)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in FRAMES.items()], "frame_key string, payload string")
    assert {r.frame_key: (r.status_code, r.response and json.loads(r.response)) for r in R.run(df).collect()} == got
