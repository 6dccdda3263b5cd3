"""Intermediate tables in the cluster's shared folder: they cut lineage, are computed once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A table of more rows is sent whole to no executor, however small its files are.
MANY = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one's own only on a local master, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by key to as many tasks as shuffles have: for rows that are few bytes in a file, but much work.

    Batches of what such rows become reach Python workers by 4 MB, for an executor holds each several times.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *key)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written and read again. The shuffles behind it go as soon as it is written, for nothing asks for them any more."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def saved_wide(df: DataFrame, name: str) -> DataFrame:
    """saved() for wide rows that are much alike: their files say little of their size in memory, so joins go by rows.

    Columns that repeat take next to nothing in a file. Spark goes by its size, and would gather such a table at the driver.
    """
    out = saved(df, name)
    return out.hint("merge") if out.count() > MANY else out
