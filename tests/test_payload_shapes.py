"""Payload shapes beyond one level: nested containers, the last resort, names in any case, keypoints of every encoding."""

import json

import pytest

from framemill.sources import payload as P

ONE = {"score": 0.5, "bbox": [1, 2, 30, 40], "label": "a"}


def nest(depth):
    out = {"predictions": [ONE]}
    for _ in range(depth):
        out = {"data": out}
    return out


SHAPES = [
    ({"data": {"output": {"predictions": [ONE]}}}, 200, 1),
    ({"found": [ONE]}, 200, 1),
    ({"data": {"output": {"found": [ONE, ONE]}}}, 200, 2),
    ({"found": [{"Conf": 0.5}]}, 200, 1),
    ({"found": [{"other": 1}]}, 422, None),
    ({"predictions": {"items": [ONE]}, "data": [ONE, ONE]}, 200, 1),
    ({"output": {"nothing": 1}, "items": [ONE]}, 200, 1),
    ({"b": [ONE], "a": [ONE, ONE]}, 200, 1),
    (nest(4), 200, 1),
    (nest(5), 200, 0),
    ({"results": {"nothing": 1}}, 200, 0),
    ({"Boxes": [[1, 2, 3, 4], [1, 2, 3, 4]], "confs": [0.5]}, 200, 2),
    ({"predictions": []}, 200, 0),
    ({"data": {"instances": [], "predictions": [ONE]}, "items": [ONE, ONE, ONE]}, 200, 3),
    ({"data": {"output": {"items": [ONE]}, "items": []}}, 200, 1),
    ({"payload": {"z": [ONE], "a": [ONE, ONE]}, "params": {}}, 200, 1),
    ([], 200, 0),
]


def read(spark, payloads):
    return P.read_frames(spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "frame_key long, payload string"))


def test_containers(spark):
    got = {r.frame_key: r for r in read(spark, [p for p, _, _ in SHAPES]).selectExpr("frame_key", "status_code", "IF(error IS NULL, size(items), NULL) AS n").collect()}
    assert [(got[i].status_code, got[i].n) for i in range(len(SHAPES))] == [(code, n) for _, code, n in SHAPES]


def test_names_in_any_case(spark):
    items = [{"Score": 0.1, "Bbox": [1, 2, 3, 4], "CLASS_NAME": "a", "Track_ID": 7}, {"BBOX": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "sCoRe": 0.25}]
    a, b = P.read_instances(read(spark, [items]), bbox_format="xyxy").orderBy("source_index").collect()
    assert (a.score, tuple(a.box), a.label, a.track_id) == (0.1, (1, 2, 3, 4), "a", "7")
    assert (b.score, tuple(b.box)) == (0.25, (1, 2, 3, 4))


@pytest.mark.parametrize(
    "kps,want",
    [
        ([{"x": 1, "y": 2, "score": 0.5}, {"X": 3, "y": 4, "v": 2}, {"x": 5, "y": 6, "visibility": None}], [(1, 2, 0.5), (3, 4, 2), (5, 6, 1)]),
        ([[1, 2, 0.5], [3, 4], [5], [6, 7, 2, 9]], [(1, 2, 0.5), (3, 4, 1), (6, 7, 2)]),
        ({"points": [{"x": 1, "y": 2, "confidence": 0.5}]}, [(1, 2, 0.5)]),
        ([1, 2, 0, 3, 4, 1, 5, 6, 2], [(1, 2, 0), (3, 4, 0.5), (5, 6, 1)]),
        ([1, 2, 3, 4], [(1, 2, 1), (3, 4, 1)]),
        ([{"x": "a", "y": 2}], None),
    ],
)
def test_keypoints(spark, kps, want):
    r = P.read_instances(read(spark, [[{"Keypoints": kps}]])).head()
    assert (r.keypoints and [tuple(k) for k in r.keypoints]) == want
