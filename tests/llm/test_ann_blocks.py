"""Queries of a leaf are dealt to bounded blocks, and every query still meets every point of its leaves once."""

import numpy as np
from pyspark.sql import functions as F

from framemill.llm import ann


def test_groups_are_bounded_and_complete(spark):
    asked = spark.range(600).selectExpr("id AS query", "id AS vec_id", "0 AS tree", "CAST(IF(id < 590, 3, 4) AS bigint) AS leaf")
    indexed = spark.range(90).selectExpr("id AS point", "0 AS tree", "CAST(id % 3 + 3 AS bigint) AS leaf")
    a, b = ann.meet(asked, indexed, 3, 50)
    group = ["tree", "leaf", "part", "block"]
    assert max(r["count"] for r in a.groupBy(*group).count().collect()) <= 100  # 590 without blocks
    assert max(r["count"] for r in b.groupBy(*group).count().collect()) <= 30
    pairs = [(r.vec_id, r.point) for r in a.join(b, group).select("vec_id", "point").collect()]
    assert len(pairs) == len(set(pairs)) == 590 * 30 + 10 * 30


def test_blocks_change_no_result(spark):
    x = np.random.default_rng(2).standard_normal((400, 6))
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(20, [float(v) for v in x[20]])] * 3, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, queries=n).collect())) for n in (10**6, 2))
    assert one == many and len(one) == 20 * 20
