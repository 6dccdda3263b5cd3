from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framemill import queries as Q
from framemill.config import SegmentationParams
from framemill.functions import geometry as G
from framemill.operators import masks as M
from framemill.sources import payload as P

SF = "/root/testdata/sf0.001"
SLOW = {"q_ingest_rows"}  # covered by test_payloads


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_payloads(spark):
    rows = [(1, '[{"conf": 0.5, "name": "a", "rect": [10, 10, 40, 40]}, 3, {"bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}]'), (2, ""), (3, "{bad"), (4, '{"totally": "unrelated"}'), (5, '{"predictions": []}'), (6, None)]
    head = P.read_frames(spark.createDataFrame(rows, "frame_key long, payload string"))
    assert {r.frame_key: r.status_code for r in head.collect()} == {1: 200, 2: 400, 3: 400, 4: 422, 5: 200, 6: 400}
    got = P.read_instances(head).orderBy("source_index").collect()
    assert [(r.source_index, r.score, r.label) for r in got] == [(0, 0.5, "a"), (2, 1.0, None)]
    assert tuple(got[1].box) == (1, 2, 4, 6)


def test_params_out_of_range():
    with pytest.raises(ValueError):
        SegmentationParams(confidence_threshold=5.0)


def test_square_polygon_has_100_pixels(spark):
    pts = [(4.0, 4.0), (14.0, 4.0), (14.0, 14.0), (4.0, 14.0)]
    df = spark.createDataFrame([(1, pts)], "k int, points array<struct<x:double,y:double>>")
    r = M.fill(df, ["k"], 20, 20).select(G.run_area(F.col("runs")).alias("a"), G.run_box(F.col("runs")).alias("b")).head()
    assert r.a == 100 and tuple(r.b) == (4, 4, 14, 14)


def test_mask_kernels():
    m = np.zeros((12, 12), bool)
    m[2:9, 2:9] = True
    m[4:6, 4:6] = False
    whole = m.copy()
    whole[2:9, 2:9] = True
    assert M.without_holes(M.to_runs(m), 12, 12) == M.to_runs(whole)
    m[11, 11] = True
    runs = M.to_runs(m)
    assert len(set(M.label_runs(runs))) == 2
    assert sum(r["x1"] - r["x0"] for r in M.without_small(runs, 2)) == 45
    assert len(M.polygons_of(whole, 1.0)[0]) == 8


@pytest.mark.parametrize("counts", [[0, 5, 3], [7, 1, 900, 2, 60000, 1], [1]])
def test_leb_round_trip(counts):
    assert M.leb_decode(M.leb_encode(counts)) == counts
