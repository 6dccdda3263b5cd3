"""Keypoint smoothing across frames: one step against the previous frame, the recursive chain in batch, and keyed state on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def smooth_pairwise(df: DataFrame, stream: list[str], order: list[str], kps: str, alpha: float, max_jump: float | None = None) -> DataFrame:
    """Each row against the raw row before it in its stream."""
    prev = F.lag(kps).over(Window.partitionBy(*stream).orderBy(*order))
    return df.withColumn("_prev", prev).withColumn(kps, F.when(F.col("_prev").isNull(), F.col(kps)).otherwise(G.blend(F.col(kps), F.col("_prev"), alpha, max_jump))).drop("_prev")


def smooth_recursive(df: DataFrame, stream: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """The chained moving average of a number: a fold over each stream's ordered rows."""
    rows = df.groupBy(*stream).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_a"))
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x["_v"]).otherwise(alpha * x["_v"] + (1 - alpha) * F.try_element_at(acc, F.lit(-1)))))
    out = F.aggregate("_a", F.array().cast("array<double>"), step)
    return rows.select(*stream, F.explode(F.arrays_zip(F.col("_a"), out.alias("_s"))).alias("z")).select(*stream, *[F.col(f"z._a.{c}").alias(c) for c in order], F.col("z._s").alias("smoothed"))


def match_previous(cur: DataFrame, prev: DataFrame, stream: list[str], similarity: Column, threshold: float) -> DataFrame:
    """cur with the matched previous instance: by track id, the last duplicate winning, else the most similar at or above the threshold.

    cur has idx, track_id, keypoints; prev has p_idx, p_track_id, p_keypoints and the same stream columns. similarity is
    an expression over both. Tracked previous instances win ties over untracked ones, then the lower p_idx.
    """
    pairs = cur.join(prev, stream, "left")
    same = F.col("track_id").cast("string") == F.col("p_track_id").cast("string")
    sim = F.when(F.size("keypoints") == F.size("p_keypoints"), similarity)
    place = lambda kind, near, tracked, tie: F.struct(F.lit(kind).alias("kind"), near.alias("near"), tracked.cast("int").alias("tracked"), tie.cast("long").alias("tie"))
    rank = F.when(same, place(2, F.lit(0.0), F.lit(0), F.col("p_idx"))).when(sim >= threshold, place(1, sim, F.col("p_track_id").isNotNull(), -F.col("p_idx")))
    best = F.max_by(F.struct("p_idx", "p_keypoints"), rank)
    out = pairs.groupBy(*stream, "idx").agg(best.alias("m"), F.max(rank).isNotNull().alias("matched"))
    return out.select(*stream, "idx", F.when(F.col("matched"), F.col("m.p_idx")).alias("p_idx"), F.when(F.col("matched"), F.col("m.p_keypoints")).alias("p_keypoints"))


def smooth_stream(df: DataFrame, stream: str, order: str, value: str, alpha: float) -> DataFrame:
    """The recursive average on a stream: the last value is kept as state per key; rows of a batch run in order."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        pdf = pd.concat(list(frames)).sort_values(order)
        last, out = (state.get[0] if state.exists else None), []
        for v in pdf[value]:
            last = float(v) if last is None else alpha * float(v) + (1 - alpha) * last
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({stream: pdf[stream], order: pdf[order], "smoothed": out})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (stream, order)}
    return df.groupBy(stream).applyInPandasWithState(update, f"{stream} {kinds[stream]}, {order} {kinds[order]}, smoothed double", "last double", "append", "NoTimeout")
