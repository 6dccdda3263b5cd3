"""The sink of responses: read back whole, once a frame, after retries and killed tasks."""

import os
import signal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from framemill.sources import sink

SCHEMA = "frame_key string, status_code int, n_instances int, response string, error string"


def rows(spark, *keys, text="a", bad=()):
    made = [(k, 422 if k in bad else 200, 0 if k in bad else 1, None if k in bad else text, "no" if k in bad else None) for k in keys]
    return spark.createDataFrame(made, SCHEMA)


def got(spark, folder):
    return sorted((r.frame_key or "", r.batch, r.status_code, r.response, r.error) for r in sink.read(spark, folder).collect())


def test_round_trip_and_retry(spark, tmp_path):
    folder = str(tmp_path)
    assert sink.read(spark, folder).count() == 0
    for _ in range(2):  # a batch tried twice is there once
        sink.write(rows(spark, "a", "b", None, "c", bad=("c",)), folder, "1")
    assert got(spark, folder) == [("", "1", 200, "a", None), ("a", "1", 200, "a", None), ("b", "1", 200, "a", None), ("c", "1", 422, None, "no")]
    assert sorted(r.frame_key for r in sink.pending(rows(spark, "a", "c", "d", None), folder).collect()) == ["c", "d"]
    sink.write(rows(spark, "c", "d", text="z"), folder, "2")
    assert [x[:4] for x in got(spark, folder)][-2:] == [("c", "2", 200, "z"), ("d", "2", 200, "z")]
    sink.write(rows(spark, "a"), folder, "1")  # written anew with fewer frames: the others of that batch go
    assert [x[:3] for x in got(spark, folder)] == [("a", "1", 200), ("c", "2", 200), ("d", "2", 200)]
    sink.write(rows(spark, "a").where("false"), folder, "3")
    assert len(got(spark, folder)) == 3


def test_repeated_keys_are_one_frame(spark, tmp_path):
    sink.write(rows(spark, "a", "a").union(rows(spark, "a", bad=("a",))), str(tmp_path), "1")
    assert [x[:3] for x in got(spark, str(tmp_path))] == [("a", "1", 422)]


def test_killed_job_leaves_nothing_half(spark, tmp_path):
    """The worker of one frame dies: local mode has no second attempt, so the job fails, and a retry gives every frame once."""
    folder, flag = str(tmp_path / "out"), str(tmp_path / "died")
    sink.write(rows(spark, "x"), folder, "0")

    @udf("string")
    def fatal(key):
        if key == "k7" and not os.path.exists(flag):
            open(flag, "w").close()
            os.kill(os.getpid(), signal.SIGKILL)
        return key

    base = spark.range(200).repartition(4).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    many = base.select(fatal("k").alias("frame_key"), F.lit(200).alias("status_code"), F.lit(1).alias("n_instances"), F.lit("a").alias("response"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception):
        sink.write(many, folder, "1")
    assert not os.path.exists(f"{folder}/done/batch=1")
    assert [x[:2] for x in got(spark, folder)] == [("x", "0")]
    sink.write(many, folder, "1")
    assert len(got(spark, folder)) == 201 == sink.read(spark, folder).select("frame_key").distinct().count()


def test_unmarked_batch_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    sink.write(rows(spark, "a"), folder, "1")
    rows(spark, "b").select("frame_key", "status_code", "n_instances", "response", F.lit(0).alias("part")).write.partitionBy("part").parquet(f"{folder}/answers/batch=2")
    assert [x[:2] for x in got(spark, folder)] == [("a", "1")]
