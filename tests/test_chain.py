"""The chain of smoothed poses: slices of any cut, a stream in micro-batches, gaps, late frames, matches by track and by likeness."""

import random

import pytest
from pyspark.sql import functions as F

from framemill.streaming import chain as C

SCHEMA = "cam string, t double, idx long, track_id string, keypoints array<struct<x:double,y:double,score:double>>, area double"


def pose(x, n=3, score=0.9):
    return [(x + 10.0 * j, 5.0 * j, score) for j in range(n)]


def frames(seed=1):
    r, out = random.Random(seed), []
    for cam in ("a", "b", "c"):
        for t in range(12):
            for i in range(r.randrange(3)):
                out.append((cam, float(t), i, r.choice([None, str(i)]), pose(100.0 * i + r.uniform(-2, 2), r.choice([3, 3, 3, 4])), 400.0))
    return out


def key(rows):
    return sorted((r.cam, r.t, r.idx, r.smoothed, tuple((round(k.x, 9), round(k.y, 9), k.score) for k in r.keypoints)) for r in rows)


def test_slices_agree(spark):
    df = spark.createDataFrame(frames(), SCHEMA)
    whole = key(C.smooth_poses(df, "cam", "t").collect())
    assert len(whole) == df.count() and any(r[3] for r in whole)
    assert key(C.smooth_poses(df.repartition(3), "cam", "t", cuts=[3.0, 4.0, 9.5]).collect()) == whole


def test_stream_equals_batch(spark, tmp_path):
    rows = frames(2)
    for k, (lo, hi) in enumerate(((0, 4), (4, 5), (5, 12))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = C.smooth_pose_stream(stream, "cam", "t").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert key(got) == key(C.smooth_poses(spark.createDataFrame(rows, SCHEMA), "cam", "t").collect())


def test_by_hand():
    import pandas as pd

    def run(rows, last=None, **more):
        df = pd.DataFrame([{"_o": t, "_i": i, "_t": k, "_k": [v for p in pts for v in p], "_a": 400.0} for t, i, k, pts in rows])
        out, last = C.Chain(alpha=0.5, **more).run(df, last)
        return [(m, k[0]) for m, k in zip(out["_m"], out["_k"])], last

    first = [(0.0, 0, "7", pose(100.0))]
    assert run([*first, (1.0, 0, "7", pose(110.0)), (2.0, 0, "7", pose(110.0))])[0] == [(False, 100), (True, 105), (True, 107.5)]
    assert run([*first, (1.0, 0, "8", pose(101.0)), (1.0, 1, None, pose(300.0))])[0] == [(False, 100), (True, 100.5), (False, 300)]  # by likeness
    assert run([*first, (9.0, 0, "7", pose(110.0))], max_gap=5)[0] == [(False, 100), (False, 110)]
    assert run([*first, (9.0, 0, "7", pose(110.0))], max_jump=5)[0] == [(False, 100), (True, 110)]
    _, last = run(first)
    late, same = run([(0.0, 0, "7", pose(110.0))], last)
    assert late == [(False, 110)] and same is last
    assert run([*first, (1.0, 0, "7", pose(110.0, 4))])[0][1] == (True, 110)  # other joints: matched, not blended


@pytest.mark.parametrize("rows", [[], [("a", 1.0, 0, None, None, None)], [("a", 1.0, 0, None, [], None)]])
def test_nothing_to_smooth(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.smooth_poses(df, "cam", "t", cuts=[2.0]).where(F.size("keypoints") > 0).count() == 0
