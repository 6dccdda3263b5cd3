"""Smoothing of poses along a stream of frames: each frame is matched with the last answered one and blended with it.

An instance takes the one of its track id (of repeated ids the last), else the most similar instance at or above a
threshold, if their joints are as many; ties go to tracked ones, then to the earlier. Joints seen on both sides, and not
too far apart, move to alpha * now + (1 - alpha) * before. What is answered is what the next frame meets.

Frames that are missing, or have no instances, leave the last answered frame as it is; one more than max_gap back counts
as none. A frame no later than the last answered one is answered as it came and leaves the state alone, so on a stream
frames out of order are answered, unsmoothed. All instances of a frame come together. The state of a stream is one frame.

In batch, time is cut into slices: a slice is one job over all streams, which takes and hands over their states, so a
stream of any length never is one task's rows. On a stream the same step runs on keyed state with a time-out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import geometry as G
from ..tables import saved

POINTS = "array<struct<x:double,y:double,score:double>>"


class Chain:
    """The step from frame to frame. A frame's state: its order, track ids and keypoints (rows of x, y, score)."""

    def __init__(self, alpha: float = 0.6, threshold: float = 0.5, max_jump: float | None = None, max_gap: float | None = None, sigmas: list[float] = G.COCO17_SIGMAS):
        self.alpha, self.threshold, self.max_jump, self.max_gap, self.sigmas = alpha, threshold, max_jump, max_gap, np.array(sigmas)

    def similarity(self, a: np.ndarray, b: np.ndarray, area: float) -> float:
        on = (a[:, 2] > 0) & (b[:, 2] > 0)
        if not on.any():
            return 0.0
        s = np.full(len(a), G.DEFAULT_SIGMA)
        s[: len(self.sigmas)] = self.sigmas[: len(a)]
        d = ((a[:, :2] - b[:, :2]) ** 2).sum(axis=1)
        return float(np.exp(-d[on] / ((2 * s[on]) ** 2 * max(area, 1.0) * 2)).mean())

    def match(self, track: str | None, now: np.ndarray, area: float, last: tuple) -> np.ndarray | None:
        _, tracks, points = last
        by_track = {t: p for t, p in zip(tracks, points) if t is not None}
        if track in by_track:
            return by_track[track]
        best, found = 0.0, None
        for p in [*by_track.values(), *(p for t, p in zip(tracks, points) if t is None)]:
            near = self.similarity(now, p, area) if p.shape == now.shape else 0.0
            if near > best and near >= self.threshold:
                best, found = near, p
        return found

    def blend(self, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        if now.shape != before.shape:
            return now
        on = (now[:, 2] > 0) & (before[:, 2] > 0)
        if self.max_jump is not None:
            on &= np.hypot(*(now[:, :2] - before[:, :2]).T) <= self.max_jump
        out = now.copy()
        out[on, :2] = self.alpha * now[on, :2] + (1 - self.alpha) * before[on, :2]
        return out

    def run(self, rows: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        """rows (_o, _i, _t, _k flat keypoints, _a area) with _k blended and _m whether matched, and the last answered frame."""
        rows = rows.sort_values(["_o", "_i"], kind="stable")
        points, matched = [], []
        for at, frame in rows.groupby("_o", sort=True):
            late = last is not None and at <= last[0]
            usable = last is not None and not late and (self.max_gap is None or at - last[0] <= self.max_gap)
            own, tracks = [], [None if pd.isna(t) else t for t in frame["_t"]]
            for t, flat, area in zip(tracks, frame["_k"], frame["_a"]):
                now = np.asarray(flat, dtype=float).reshape(-1, 3)
                before = self.match(t, now, area, last) if usable else None
                own.append(now if before is None else self.blend(now, before))
                matched.append(before is not None)
            points += own
            if not late:
                last = (at, tracks, own)
        return rows.assign(_k=[p.ravel().tolist() for p in points], _m=matched), last


def _flat(df: DataFrame, stream: str, order: Column, index: str) -> DataFrame:
    flat = F.flatten(F.transform("keypoints", lambda k: F.array(k["x"], k["y"], k["score"])))
    return df.where("keypoints is not null").select(stream, order.cast("double").alias("_o"), F.col(index).cast("long").alias("_i"), F.col("track_id").cast("string").alias("_t"), flat.alias("_k"), F.coalesce("area", F.lit(1.0)).alias("_a"))


def _answer(rows: DataFrame, stream: str, order: str, index: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), (F.size("_k") / 3).cast("int") - 1), lambda i: F.struct(F.get("_k", i * 3).alias("x"), F.get("_k", i * 3 + 1).alias("y"), F.get("_k", i * 3 + 2).alias("score")))
    return rows.select(stream, F.col("_o").alias(order), F.col("_i").alias(index), F.col("_t").alias("track_id"), F.when(F.size("_k") > 0, points).otherwise(F.array().cast(POINTS)).alias("keypoints"), F.col("_m").alias("smoothed"))


ROW = "_o double, _i long, _t string, _k array<double>, _a double, _m boolean"


def smooth_poses(df: DataFrame, stream: str, order: str, cuts: list[float] = (), index: str = "idx", **chain) -> DataFrame:
    """df (stream, order, index, track_id, keypoints, area) with keypoints along the chain: stream, order, index, track_id, keypoints, smoothed.

    cuts: ascending orders at which a new slice begins; a slice of a stream must fit a task. chain: settings of Chain.
    """
    step, rows = Chain(**chain), _flat(df, stream, F.col(order), index)
    kind = df.schema[stream].dataType.simpleString()
    state, parts = None, []

    def both(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        last = pickle.loads(before["_last"].iloc[0]) if len(before) else None
        out, last = step.run(own, last) if len(own) else (own.assign(_m=pd.Series(dtype=bool)), last)
        out = out.assign(_last=None)
        name = own[stream].iloc[0] if len(own) else before[stream].iloc[0]
        columns = [stream, "_o", "_i", "_t", "_k", "_a", "_m", "_last"]
        table = [out[c].tolist() + [{stream: name, "_last": pickle.dumps(last)}.get(c)] for c in columns]
        return pd.DataFrame(dict(zip(columns, (pd.Series(v, dtype=object) for v in table)))).astype({"_o": "Float64", "_i": "Int64", "_a": "Float64", "_m": "boolean"})

    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        own = rows if lo is None else rows.where(F.col("_o") >= lo)
        own = own if hi is None else own.where(F.col("_o") < hi)
        before = state if state is not None else df.sparkSession.createDataFrame([], f"{stream} {kind}, _last binary")
        done = saved(own.groupBy(stream).cogroup(before.groupBy(stream)).applyInPandas(both, f"{stream} {kind}, {ROW}, _last binary"), "slice")
        parts.append(done.where("_last is null"))
        state = done.where("_last is not null").select(stream, "_last")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _answer(out, stream, order, index)


def smooth_pose_stream(df: DataFrame, stream: str, order: str, index: str = "idx", idle_ms: int | None = None, **chain) -> DataFrame:
    """The chain on a streaming df; a stream that sends nothing for idle_ms of processing time is forgotten (None: never)."""
    step = Chain(**chain)
    kind = df.schema[stream].dataType.simpleString()

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches))
        last = pickle.loads(state.get[0]) if state.exists else None
        out, last = step.run(own, last)
        state.update((pickle.dumps(last),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out[[stream, "_o", "_i", "_t", "_k", "_a", "_m"]]

    rows = _flat(df, stream, F.col(order), index).groupBy(stream).applyInPandasWithState(update, f"{stream} {kind}, {ROW}", "last binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
    return _answer(rows, stream, order, index)
