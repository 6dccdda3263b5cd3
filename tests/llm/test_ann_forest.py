"""Trees that do split: bounded buckets, recall against brute force, ties, repeated ids, fewer candidates than asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemill.llm import ann

rng = np.random.default_rng(11)
CENTRES = rng.standard_normal((12, 16))
X = CENTRES[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))
X[700:720] = X[700]


def table(spark, x, ids=None, more=()):
    rows = [(int(i), [float(a) for a in r], "clash") for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame([*rows, *more], "vec_id long, embedding array<double>, score string")


def ask(df, **more):
    by = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **more).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in by.items()}


def dot(a, b):
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        out += x * y
    return out


@pytest.mark.parametrize("bucket", [16_384, 200, 20])
def test_recall_and_scores(spark, bucket):
    got = ask(table(spark, X), bucket=bucket, leaf=32)
    hit = 0
    for q, found in got.items():
        want = sorted(((-dot(X[q], X[i]), i) for i in range(len(X)) if i != q))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == dot(X[q], X[i]) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i in want} & {i for _, i, _ in found})
    assert set(got) == set(range(0, 1500, 20)) and hit >= 0.9 * 20 * len(got)


def test_buckets_change_no_result(spark):
    assert ask(table(spark, X), bucket=10**6, leaf=32) == ask(table(spark, X), bucket=150, queries=3, leaf=32)


def test_ties_go_to_smaller_ids_and_no_group_is_unbounded(spark):
    x = np.eye(8)[np.arange(400) % 8]  # every score is 0 or 1
    x = x * (1 + np.arange(400)[:, None] / 1000 * (np.arange(400)[:, None] % 2))
    got = ask(table(spark, x), leaf=1000)
    for q, found in got.items():
        want = sorted(((-dot(x[q], x[i]), i) for i in range(400) if i != q))[:20]
        assert [i for _, i, _ in found] == [i for _, i in want]


def test_fewer_candidates_and_odd_rows(spark):
    more = [(900, None, None), (901, [0.0, 0.0], None), (902, [float("nan"), 1.0], None), (903, [], None), (904, [1.0], None), (None, [1.0, 1.0], None)]
    got = ask(table(spark, np.array([[1.0, 0], [0, 1], [1, 1], [1, 1]]), [0, 1, 2, 2], more))
    assert got == {0: [(1, 2, 1.0), (2, 1, 0.0)]}


def test_repeated_ids(spark):
    got = ann.nearest(table(spark, np.array([[1.0, 0], [0, 1], [2, 1], [1, 2]]), [20, 20, 1, 2]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 2.0), (20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0)]
