"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE vectors with the smallest md5 of their id); every vector is indexed. A node
splits at the median of the sample along a random direction; the directions of a tree's levels are orthogonal, so no
level asks again what another has asked. A query walks all trees through one priority queue ordered by how far it lies
beyond the splits on the way to a node, until it has visited its budget of leaves; the budget is the least that reaches
RECALL on sample queries, of the whole forest if none does.

Neighbouring leaves are packed into buckets of at most BUCKET points (a larger leaf is dealt to several), and queries of
a bucket into blocks of about QUERIES, each of which meets a copy of the bucket, so both sides of a group are bounded
whatever the table's size. Within a group a query meets the points of its own leaves only. Inner products pick
candidates; their scores are added up again in the order of the coordinates, so a pair has one score wherever it is
found, and a group gives each of its queries k rows at most. The best of all groups are merged.

Equal vectors are one point with its smallest ids, as many as a result can hold, so a vector that fills a third of the
table is a single candidate. Vectors are lifted by one coordinate so that inner products order like distances.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; neither do
vectors of another length than the sample's most common one; rows with a null id take no part; queries need not be
indexed; equal rows are one row; rows that share an id but not the vector each ask under that id, and none is a candidate
of the others; with fewer candidates than k, all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, TREES, SAMPLE, RECALL = 20, 2, 8192, 0.94
#: A leaf holds LEAF points on average until a tree has 2 ** MAX_DEPTH leaves.
LEAF, MAX_DEPTH, BUCKET, QUERIES, SEED = 64, 10, 16_384, 1024, 7


class Forest:
    """Splits by node: children of i are 2i+1 and 2i+2; the last level's nodes are the leaves."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.depth, self.trees, self.inner = depth, trees, (1 << depth) - 1
        bases = [[np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-depth // dim))] for _ in range(trees)]
        self.normals = np.stack([np.concatenate(b)[:depth] if b else np.zeros((0, dim)) for b in bases])
        self.cuts = np.zeros((trees, self.inner))
        self.level = np.array([(i + 1).bit_length() - 1 for i in range(self.inner)], dtype=np.int64)
        for t in range(trees):
            along, groups = sample @ self.normals[t].T, [np.arange(len(sample))]
            for i in range(self.inner):
                a = along[groups[i], self.level[i]]
                self.cuts[t, i] = np.median(a) if len(a) else 0.0
                groups += [groups[i][a < self.cuts[t, i]], groups[i][a >= self.cuts[t, i]]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, a row per tree."""
        out = np.zeros((self.trees, len(x)), dtype=np.int64)
        for t in range(self.trees):
            along, node = x @ self.normals[t].T, np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                node = 2 * node + 1 + (along[:, d] >= self.cuts[t, node])
            out[t] = node - self.inner
        return out

    def margins(self, q: np.ndarray) -> list[list[list[float]]]:
        """By query, tree and node: how far the query lies above the split."""
        along = np.einsum("qd,tld->qtl", q, self.normals)
        return (along[:, :, self.level] - self.cuts).tolist()

    def visit(self, margins: list[list[float]], budget: int, sizes: np.ndarray | None = None, least: int = 0) -> list[tuple[int, int]]:
        """The first budget (tree, leaf) in order of the shared queue, more if no tree has shown least points by then."""
        heap, out, seen = [(0.0, t, 0) for t in range(self.trees)], [], [0] * self.trees
        while heap and (len(out) < budget or max(seen) < least):
            far, t, i = heapq.heappop(heap)
            own = margins[t]
            while i < self.inner:
                a = own[i]
                near, other = (2 * i + 2, 2 * i + 1) if a >= 0 else (2 * i + 1, 2 * i + 2)
                heapq.heappush(heap, (far + a * a, t, other))
                i = near
            out.append((t, i - self.inner))
            if sizes is not None:
                seen[t] += int(sizes[t, i - self.inner])
        return out


def fit(sample: np.ndarray, depth: int, k: int = K, recall: float = RECALL) -> tuple[Forest, int]:
    """A forest and the least budget of leaves that finds the share recall of sample queries' neighbours."""
    forest = Forest(sample, depth)
    every = forest.trees << depth
    queries = sample[:: max(1, len(sample) // 128)]
    best = np.argsort(-(queries[:, :-1] @ sample[:, :-1].T), axis=1, kind="stable")[:, 1 : k + 1]
    leaves = forest.leaves(sample)
    found = np.zeros(every)
    for margins, near in zip(forest.margins(queries), best):
        place = {x: n for n, x in enumerate(forest.visit(margins, every))}
        for j in near:
            found[min(place[(t, leaves[t, j])] for t in range(forest.trees))] += 1
    share = np.cumsum(found) / max(1, found.sum())
    return forest, min(every, int(np.searchsorted(share, recall)) + 1)


def pack(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """bucket and parts of each (tree, leaf): neighbours share a bucket of at most most points, a larger leaf has parts."""
    bucket, parts, n = np.zeros(sizes.shape, dtype=np.int64), np.ones(sizes.shape, dtype=np.int64), 0
    for t, own in enumerate(sizes):
        held = 0
        for i, s in enumerate(own.tolist()):
            if i and held + s > most:
                n, held = n + 1, 0
            bucket[t, i], held = n, held + s
            parts[t, i] = max(1, -(-s // most))
        n += 1
    return bucket, parts


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, longest * longest - (x * x).sum(axis=1)))[:, None]), axis=1)


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def meet(asked: DataFrame, indexed: DataFrame, parts: int | str, size: int, key: tuple[str, ...] = ("tree", "leaf")) -> tuple[DataFrame, DataFrame]:
    """Both sides with part and block: within a key every query and point share exactly one pair of them.

    asked has query and the key (and is read twice), indexed has point and the key; parts is a number or a column of both.
    Keys without queries are left out.
    """
    blocks = asked.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))  # a row a leaf at most
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    parts = F.lit(parts) if isinstance(parts, int) else F.col(parts)
    asked, indexed = (df.join(F.broadcast(blocks), [*key]) for df in (asked, indexed))
    asked = asked.withColumn("block", deal("query", F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    indexed = indexed.withColumn("part", deal("point", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return asked.drop("blocks"), indexed.drop("blocks")


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added up coordinate by coordinate."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def best_of(q: np.ndarray, own: np.ndarray, visits: list[np.ndarray], x: np.ndarray, ids: list[np.ndarray], leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of each query's k best points in its leaves; x lies in order of leaf.

    A tie goes to the point with the smallest id that isn't the query's own; points with no other id are left out.
    """
    names, first = np.unique(leaf, return_index=True)
    last = np.append(first[1:], len(leaf))
    lengths = np.sqrt((x * x).sum(axis=1))
    one, two = np.array([i[0] for i in ids]), np.array([i[1] if len(i) > 1 else np.iinfo(np.int64).max for i in ids])
    goes = np.zeros((len(q), len(names)), dtype=bool)
    for i, v in enumerate(visits):
        goes[i] = np.isin(names, v)
    out = []
    step = max(1, (1 << 21) // max(1, len(x)))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        s = np.full((len(some), len(x)), -np.inf)
        for n, (a, b) in enumerate(zip(first, last)):
            who = np.flatnonzero(goes[lo : lo + step, n])
            s[who, a:b] = some[who] @ x[a:b].T
        m = min(k + 1, s.shape[1])
        slack = 1e-12 * np.sqrt((some * some).sum(axis=1)) * lengths.max()  # far more than two orders of summation differ by
        edge = -np.partition(-s, m - 1, axis=1)[:, m - 1] - slack
        i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
        tie = np.where(one[j] == own[lo + i], two[j], one[j])
        i, j, tie = (c[tie < np.iinfo(np.int64).max] for c in (i, j, tie))
        score = np.concatenate([in_order(some[i[c : c + 65536]], x[j[c : c + 65536]]) for c in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((tie, -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < k] + lo, j[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, queries: int = QUERIES, bucket: int = BUCKET, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the columns of vectors."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.transform(vector_col, lambda x: x.cast("double"))
    good = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    rows = good.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm).where("norm > 0")
    # equal vectors: one point with the k + 1 smallest ids
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    points = scratch.save(kept.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.max("norm").alias("norm")).withColumn("point", F.monotonically_increasing_id()), "points")
    sample = points.select("v", F.md5(F.get("ids", F.lit(0)).cast("string")).alias("o")).orderBy("o").limit(SAMPLE).toPandas()  # bounded
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], empty)
    width = int(sample["v"].map(len).mode()[0])
    points, rows = points.where(F.size("v") == width), rows.where(F.size("v") == width)
    total, longest = points.agg(F.count("*"), F.max("norm")).head()
    depth = max(0, min(MAX_DEPTH, int(np.ceil(np.log2(max(1, total / leaf))))))
    base = _lift(np.stack([x for x in sample["v"] if len(x) == width]).astype(np.float64), longest)
    forest, budget = fit(base, depth, k)
    shared = spark.sparkContext.broadcast((forest, longest))

    def index(batches):
        f, far = shared.value
        for b in batches:
            if b.num_rows:
                for t, at in enumerate(f.leaves(_lift(_matrix(b.column(0)), far))):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, t, np.int32)), pa.array(at)], [*b.schema.names, "tree", "leaf"])

    indexed = points.select("v", "ids", "point").mapInArrow(index, "v array<double>, ids array<long>, point long, tree int, leaf long")
    indexed = scratch.save(indexed, "indexed")
    sizes = np.zeros((forest.trees, 1 << depth), dtype=np.int64)
    for t, at, n in indexed.groupBy("tree", "leaf").count().collect():  # a row a leaf of the forest at most
        sizes[t, at] = n
    packed = pack(sizes, bucket)
    known = spark.sparkContext.broadcast((sizes, *packed))

    def probe(batches):
        (f, far), (held, groups, parts) = shared.value, known.value
        kind = pa.list_(pa.struct([("bucket", pa.int64()), ("parts", pa.int32()), ("leaves", pa.list_(pa.int64()))]))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, visits = b.slice(lo, 256), []
                for margins in f.margins(_lift(_matrix(part.column(1)), far)):
                    by: dict[tuple[int, int], list[int]] = {}
                    for t, i in f.visit(margins, budget, held, k + 1):
                        by.setdefault((int(groups[t, i]), int(parts[t, i])), []).append(i)
                    visits.append([{"bucket": g, "parts": n, "leaves": own} for (g, n), own in by.items()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(visits, kind)], [*b.schema.names, "visits"])

    asking = rows.where("asks").select("vec_id", "v").dropDuplicates(["vec_id", "v"]).repartition(max(1, -(-total // (4 * queries))))
    visits = asking.mapInArrow(probe, "vec_id long, v array<double>, visits array<struct<bucket:long,parts:int,leaves:array<long>>>")
    visits = scratch.save(visits.withColumn("query", F.monotonically_increasing_id()), "visits")
    of_leaf = spark.createDataFrame([(t, i, int(packed[0][t, i]), int(packed[1][t, i])) for t in range(forest.trees) for i in range(1 << depth)], "tree int, leaf long, bucket long, parts int")
    asked, indexed = meet(visits.select("query", "vec_id", "v", F.inline("visits")), indexed.join(F.broadcast(of_leaf), ["tree", "leaf"]), "parts", queries, ("bucket",))
    group = ["bucket", "part", "block"]

    def rerank(key, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("own", "int64"), ("point", "int64"), ("ids", object), ("score", float))})
        p = p.sort_values("leaf", kind="stable")
        ids, own = p["ids"].to_numpy(), q["vec_id"].to_numpy()
        i, j, score = best_of(np.stack(q["v"].to_numpy()), own, q["leaves"].tolist(), np.stack(p["v"].to_numpy()), ids, p["leaf"].to_numpy(), k)
        return pd.DataFrame({"query": q["query"].to_numpy()[i], "own": own[i], "point": p["point"].to_numpy()[j], "ids": ids[j], "score": score})

    asked = asked.select("query", "vec_id", "v", "leaves", *group).groupBy(*group)
    found = asked.cogroup(indexed.select("point", "ids", "v", "leaf", *group).groupBy(*group)).applyInPandas(rerank, "query long, own long, point long, ids array<long>, score double")
    found = found.groupBy("query", "point").agg(F.first("own").alias("query_id"), F.first("ids").alias("ids"), F.first("score").alias("score"))  # several trees find the same
    pairs = found.select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
