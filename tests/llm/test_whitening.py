"""Whitening against plain numpy and integers, its defined cases, and the registered query on a small table."""

import math
import random

import pytest

from framemill.llm import queries, whitening

rng = random.Random(11)
SCHEMA = "vec_id long, embedding array<float>, whitened string"


def vectors(n, d=10):
    return [(i, [rng.gauss(k, 1 + k) for k in range(d)]) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_numpy(spark, parts):
    rows = vectors(200)
    rows = [(i, [float(spark_float(c)) for c in v]) for i, v in rows]
    bad = [(1000, None), (1001, []), (1002, [None] * 10), (1003, [math.nan] + [0.0] * 9), (1004, [math.inf] + [0.0] * 9), (1005, [1.0] * 3), (1006, [1e30] * 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA).repartition(parts)
    w = whitening.fit(df)
    want = whitening.brute_force(rows)
    assert w.n == 200 and whitening.identity_error(df, w) < 1e-9
    got = whitening.apply(df, w).collect()
    assert sorted(r.vec_id for r in got) == list(range(200))
    for r in got:
        for c, z in enumerate(r.whitened):
            n, far, size, share = want[r.vec_id, c + 1]
            assert r.deviation == far and abs(abs(z) - size) < 1e-9 and abs(w.explained[c] - share) < 1e-12


def spark_float(c):
    import numpy as np

    return np.float32(c)


def test_constant_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], None) for i in range(5)], SCHEMA)
    w = whitening.fit(same)
    assert w.n == 5 and len(w.values) == 0
    assert [(r.deviation, r.whitened) for r in whitening.apply(same, w).collect()] == [(0, [])] * 5
    assert whitening.fit(spark.createDataFrame([], SCHEMA)) is None
    assert whitening.fit(spark.createDataFrame([(1, None, None), (2, [math.nan], None)], SCHEMA)) is None


def test_null_and_repeated_ids_and_wide_deviation(spark):
    rows = [(None, [1.0, 0.0]), (3, [2.0, 5.0]), (3, [2.0, 5.0]), (4, [3.0, 1.0]), (5, [3e12, 1.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, whitened string")
    w = whitening.fit(df)
    got = sorted(whitening.apply(df, w).collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    assert [r.vec_id for r in got] == [3, 3, 4, 5, None]
    assert got[0] == got[1] and got[3].deviation is None  # beyond 64 bits


def test_query(spark, tmp_path):
    rows = vectors(60)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = whitening.brute_force([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = queries.QUERIES["op11_chan_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 480
    for r in got:
        n, far, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, far) and abs(abs(r.whitened) - size) < 1e-9 and abs(r.explained - share) < 1e-12 and r.identity_error < 1e-9
