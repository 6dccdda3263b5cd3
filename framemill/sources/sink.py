"""Responses to a folder: answered frames and failed ones as partitioned tables, once a frame however often a batch is tried.

    answers/batch=B/part=P   frame_key, status_code, n_instances, response
    failures/batch=B/part=P  frame_key, status_code, error

A batch is what one job writes. Written again, it replaces its own partitions and nothing else, so a retry after lost
tasks or a lost job adds no row twice. What a batch holds is seen once its mark in done/ lies there; the mark is written
last. A frame that several batches hold counts as the last of them by name has it.

Defined: a null key is a frame of its own kind, kept like any other; rows of one batch with equal keys are one frame, of
which the one with the largest status, then text, stays; an empty batch is marked and holds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import saved

ANSWERS = "frame_key string, status_code int, n_instances int, response string, part int, batch string"
FAILURES = "frame_key string, status_code int, error string, part int, batch string"
PARTS = 16


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write(responses: DataFrame, folder: str, batch: str, parts: int = PARTS) -> None:
    """responses: frame_key, status_code, n_instances, response, error, as run() gives them. parts: partitions of a batch's tables."""
    key = F.col("frame_key").cast("string")
    place = F.coalesce(F.pmod(F.xxhash64(key), F.lit(parts)), F.lit(0)).cast("int")
    rows = responses.select(key.alias("frame_key"), F.col("status_code").cast("int").alias("status_code"), F.col("n_instances").cast("int").alias("n_instances"), "response", "error", place.alias("part"), F.lit(batch).alias("batch"))
    one = Window.partitionBy("part", "frame_key").orderBy(F.desc("status_code"), F.desc("response"), F.desc("error"))
    rows = saved(rows.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k"), "responses")  # read twice
    spark = responses.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done/batch={batch}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, True)  # until it is whole again, the batch isn't seen
    for name, schema, which in (("answers", ANSWERS, "status_code = 200"), ("failures", FAILURES, "status_code <> 200")):
        # the batch's folder as a whole: parts of an earlier try that this one lacks go as well
        rows.where(which).select(*_columns(schema)).drop("batch").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/batch={batch}")


def _marked(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table's rows of batches that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("name string, batch string").parquet(f"{folder}/done").select("batch").distinct()
    return spark.read.schema(schema).parquet(f"{folder}/{name}").join(done, "batch", "left_semi")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row a frame: frame_key, batch, status_code, n_instances, response, error, as the last batch that holds it says."""
    answers = _marked(spark, folder, "answers", ANSWERS).withColumn("error", F.lit(None).cast("string"))
    failures = _marked(spark, folder, "failures", FAILURES).withColumns({"n_instances": F.lit(0), "response": F.lit(None).cast("string")})
    columns = ["frame_key", "part", "batch", "status_code", "n_instances", "response", "error"]
    rows = answers.select(*columns).unionByName(failures.select(*columns))
    last = F.max_by(F.struct("batch", "status_code", "n_instances", "response", "error"), "batch").alias("r")
    return rows.groupBy("frame_key").agg(last).select("frame_key", "r.*")


def pending(frames: DataFrame, folder: str) -> DataFrame:
    """The frames (frame_key and more) that no finished batch has answered; failed ones are among them."""
    answered = _marked(frames.sparkSession, folder, "answers", ANSWERS).select(F.col("frame_key").alias("_key")).distinct()
    return frames.join(answered, F.col("frame_key").cast("string").eqNullSafe(F.col("_key")), "left_anti")
