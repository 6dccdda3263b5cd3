"""Embedding whitening from covariances merged pair by pair (Chan's formula).

Each partition keeps a count, exact integer sums and the scatter about its own mean; treeReduce merges these in pairs,
so the driver sees one state of d x d numbers whatever the number of rows. The driver takes the eigenvectors, and a
second pass merges the covariance of the whitened rows, which must be the identity.

An entry c becomes the integer x = floor(1024 * c) + 100000, so sums and deviations are exact.

Defined cases: rows whose vector is null, empty, or holds a null, non-finite or huge entry (x beyond 2**52) take no part,
nor do vectors whose length is not the commonest one (the shorter among equally common); null and repeated ids are kept
as they are; components without variance (at most d times the rounding of the first) can't be scaled and are left out; a
deviation beyond a 64-bit integer is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000  # fixed values of the contract
#: Numbers that a task turns at once.
CHUNK = 1 << 20
_LARGEST = 1 << 52

State = tuple[int, list[int], np.ndarray]


def entries(column: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the usable vectors of length d, at most CHUNK numbers and 1024 rows at once."""
    column = column.cast(pa.large_list(pa.float64()))
    off, values = column.offsets.to_numpy(), pc.fill_null(column.values, float("nan")).to_numpy()
    usable = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False) & (np.diff(off) == d))
    step = max(1, min(1024, CHUNK // d))
    for lo in range(0, len(usable), step):
        rows = usable[lo : lo + step]
        v = values[off[rows][:, None] + np.arange(d)]
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(v * SCALE) + SHIFT
            fine = np.all(np.abs(x) < _LARGEST, axis=1)  # false for nan
        yield rows[fine], x[fine].astype(np.int64)


def state_of(x: np.ndarray) -> State:
    """Count, exact sums and scatter about the mean of integer or real rows."""
    n = len(x)
    sums = x.sum(axis=0)
    centred = x - (sums / n if n else sums)
    return n, sums.tolist(), centred.T @ centred


def merged(a: State, b: State) -> State:
    """The state of both sets of rows."""
    (n, s, m), (k, t, o) = a, b
    if not n or not k:
        return a if n else b
    apart = np.array([y / k - x / n for x, y in zip(s, t)])
    return n + k, [x + y for x, y in zip(s, t)], m + o + np.outer(apart, apart) * (n * k / (n + k))


def _reduced(parts: DataFrame) -> State:
    """parts: one pickled state a partition. The depth keeps the states that one merging task reads to about 32."""
    rdd = parts.rdd.map(lambda r: pickle.loads(r[0]))
    depth = max(2, int(np.ceil(np.log(max(2, rdd.getNumPartitions())) / np.log(32))))
    return rdd.treeReduce(merged, depth)


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, eigenvalues and unit eigenvectors (columns, largest entry positive) of the covariance, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x - mean) and the exact sums of (n * x - sums) squared."""
        most = max([int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums)])
        far = x * self.n - np.array(self.sums) if most < 1 << 61 else x.astype(object) * self.n - np.array(self.sums, dtype=object)
        small = most < 1 << 61 and x.shape[1] * int(np.abs(far).max(initial=0)) ** 2 < 1 << 63
        squares = (far * far if small else far.astype(object) ** 2).sum(axis=1).tolist()
        return (far / self.n).astype(np.float64), [q if q < 1 << 63 else None for q in squares]

    def whitened(self, centred: np.ndarray, k: int) -> np.ndarray:
        return centred @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def length_of(vectors: DataFrame, vec_col: str) -> int | None:
    """The commonest length; a row a length is counted."""
    found = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found and found["d"]


def fit(vectors: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    d = length_of(vectors, vec_col)
    if d is None:
        return None

    @trimmed
    def run(batches):
        own: State = (0, [0] * d, np.zeros((d, d)))
        for b in batches:
            for _, x in entries(b.column(0), d):
                own = merged(own, state_of(x))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    n, sums, scatter = _reduced(vectors.select(vec_col).mapInArrow(run, "state binary"))
    if not n:
        return None
    values, axes = np.linalg.eigh(scatter / n)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(d)])
    total, real = float(np.trace(scatter) / n), values > max(values[0], 0) * d * np.finfo(float).eps
    return Whitening(n, sums, values[real], axes[:, real], values[real] / (total or 1.0))


def identity_error(vectors: DataFrame, w: Whitening, vec_col: str = "embedding", components: int = COMPONENTS) -> float:
    """The largest entry of |covariance of the whitened rows - identity|, by a pass of its own."""
    d, k = len(w.sums), min(components, len(w.values))

    @trimmed
    def run(batches):
        own: State = (0, [0.0] * k, np.zeros((k, k)))
        for b in batches:
            for _, x in entries(b.column(0), d):
                own = merged(own, state_of(w.whitened(w.deviations(x)[0], k)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    n, _, scatter = _reduced(vectors.select(vec_col).mapInArrow(run, "state binary"))
    return float(np.abs(scatter / n - np.eye(k)).max()) if k else 0.0


def apply(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector: vec_id, deviation, whitened (an array with one number a component)."""
    d, k = len(w.sums), min(components, len(w.values))

    @trimmed
    def run(batches):
        for b in batches:
            for rows, x in entries(b.column(1), d):
                centred, far = w.deviations(x)
                z = pa.array(w.whitened(centred, k).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), z)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(far, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = fit(vectors)
    if w is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(vectors, w)
    rows = apply(vectors, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(F.array(*[F.lit(float(s)) for s in w.explained[:COMPONENTS]], F.lit(0.0)), F.col("k"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def brute_force(rows: list[tuple[int | None, list | None]], components: int = COMPONENTS) -> dict:
    """(id, component) to (n, deviation, |whitened|, explained) by plain numpy and integers, for tests; distinct ids."""
    good = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for _, x in good])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    z = centred @ axes[:, order] / np.sqrt(values[order])
    return {(i, c + 1): (n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), abs(z[r, c]), values[order[c]] / values.sum()) for r, (i, x) in enumerate(good) for c in range(len(order))}
