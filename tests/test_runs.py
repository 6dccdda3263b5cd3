"""Runs without bitmaps, images and encodings, each against bitmaps."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemill import queries as Q
from framemill.functions import png
from framemill.operators import encodings as E
from framemill.operators import masks as M
from framemill.operators import runs as N
from framemill.sources import payload as P

RNG = np.random.default_rng(5)
MASKS = [RNG.random((h, w)) < p for h, w, p in [(12, 17, 0.6), (1, 1, 1.0), (1, 9, 0.5), (9, 1, 0.5), (30, 31, 0.2), (30, 31, 0.9), (7, 5, 0.0), (7, 5, 1.0)]]


def nearest(m, w, h):
    pick = lambda n, k: np.clip((np.arange(n) + 0.5) * k / n, 0, k - 1).astype(int)
    return m[np.ix_(pick(h, m.shape[0]), pick(w, m.shape[1]))]


def closed(m):
    """Background that no walk over sides and corners reaches from outside becomes foreground."""
    grown, free = np.pad(np.zeros_like(m), 1, constant_values=True), np.pad(~m, 1, constant_values=True)
    while True:
        p = np.pad(grown, 1)
        more = free & np.any([p[a : a + free.shape[0], b : b + free.shape[1]] for a in range(3) for b in range(3)], axis=0)
        if (more == grown).all():
            return ~grown[1:-1, 1:-1]
        grown = more


@pytest.mark.parametrize("m", MASKS, ids=lambda m: str(m.shape))
def test_turned(m):
    rows, columns = N.arrays(M.to_runs(m)), N.arrays(M.to_runs(m.T))
    assert N.listed(*N.turned(*rows)) == M.to_runs(m.T) and N.listed(*N.turned(*columns)) == M.to_runs(m)
    assert M.without_holes(M.to_runs(m), m.shape[1], m.shape[0]) == M.to_runs(closed(m))


def test_turned_takes_memory_of_the_runs():
    import tracemalloc

    n = 1 << 20  # a square of 1000 on a canvas of 2**20 x 2**20
    line = np.arange(1000) + n - 1000
    tracemalloc.start()
    y, a, b = N.turned(line, np.full(1000, n - 1000), np.full(1000, n))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (y == line).all() and (a == n - 1000).all() and (b == n).all() and most < 5e6


def test_counts_round_trip(spark):
    rows = [(i, M.to_runs(m), m.shape[1], m.shape[0]) for i, m in enumerate(MASKS)]
    df = spark.createDataFrame(rows, f"i int, runs {M.RUNS}, w int, h int")
    got = {r.i: r.c for r in df.select("i", M.encode_counts()("runs", "w", "h").alias("c")).collect()}
    for i, m in enumerate(MASKS):
        flat = m.T.ravel().astype(int)
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], flat)))).tolist()
        assert got[i] == np.diff([0, *cuts, flat.size]).tolist()
        assert sum(got[i]) == m.size


@pytest.mark.parametrize("to", [(17, 12), (40, 41), (5, 3), (1, 1), (23, 7)])
def test_resampled(spark, to):
    rows = [(i, M.to_runs(m), m.shape[1], m.shape[0]) for i, m in enumerate(MASKS)]
    df = spark.createDataFrame(rows, f"i int, runs {M.RUNS}, w int, h int")
    out = df.select("i", N.resampled(F.col("runs"), F.col("w"), F.col("h"), F.lit(to[0]), F.lit(to[1])).alias("runs"))
    assert "Python" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        assert [x.asDict() for x in r.runs] == M.to_runs(nearest(MASKS[r.i], *to)), r.i


def tiles(m, key, side):
    """Rows key, x, y, runs: the runs of each tile in its own pixels."""
    for y in range(0, m.shape[0], side):
        for x in range(0, m.shape[1], side):
            yield key, x, y, M.to_runs(m[y : y + side, x : x + side])


@pytest.fixture(scope="module")
def parts(spark):
    spiral = np.zeros((25, 25), bool)
    for k in range(0, 12, 2):
        spiral[k, k : 25 - k] = spiral[24 - k, k : 25 - k] = spiral[k : 25 - k, k] = spiral[k : 25 - k, 24 - k] = True
        if k:
            spiral[k - 1, k] = True
    every = [*MASKS, spiral, np.eye(20, dtype=bool)]
    rows = [t for i, m in enumerate(every) for t in tiles(m, i, 4)]
    df = spark.createDataFrame(rows, f"i int, x int, y0 int, runs {M.RUNS}")
    return every, N.exploded(df, ["i"], "x", "y0")


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_over_tiles(parts, diagonal):
    every, runs = parts
    got = N.components(runs, ["i"], diagonal).groupBy("i", "cy", "cx").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()
    want = set()
    for i, m in enumerate(every):
        left = {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}
        while left:
            first, work, n = min(left), [min(left)], 0
            left.discard(first)
            while work:
                y, x = work.pop()
                n += 1
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (diagonal or not dy or not dx) and (y + dy, x + dx) in left:
                            left.discard((y + dy, x + dx))
                            work.append((y + dy, x + dx))
            want.add((i, *first, n))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_holes_over_tiles(parts):
    every, runs = parts
    size = lambda k: F.element_at(F.array(*[F.lit(m.shape[k]) for m in every]), F.col("i") + 1)
    out = N.without_holes(runs, ["i"], size(1), size(0)).orderBy("i", "y", "x0").collect()
    for i, m in enumerate(every):
        assert [{"y": r.y, "x0": r.x0, "x1": r.x1} for r in out if r.i == i] == M.to_runs(closed(m)), i


def test_united(spark):
    rows = [(1, 0, 0, 5), (1, 0, 2, 3), (1, 0, 5, 6), (1, 0, 8, 9), (1, 0, 0, 5), (2, 0, 1, 2), (1, 1, 0, 1)]
    got = N.united(spark.createDataFrame(rows, "k int, y int, x0 int, x1 int"), ["k"])
    assert {tuple(r) for r in got.select("k", "y", "x0", "x1").collect()} == {(1, 0, 0, 6), (1, 0, 8, 9), (2, 0, 1, 2), (1, 1, 0, 1)}
    assert N.components(got.where("k = 9"), ["k"]).count() == 0


def test_closing_takes_no_background_by_row(spark, monkeypatch):
    """A hole is one rectangle; 64 rows of background around it are none."""
    sizes, keep = {}, N.saved

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "saved", counted)
    m = np.zeros((64, 64), bool)
    m[10:30, 10:30] = True
    m[12:28, 14:20] = False
    df = spark.createDataFrame([(i, M.to_runs(m)) for i in range(5)], f"i int, runs {M.RUNS}")
    out = N.without_holes(N.exploded(df, ["i"]), ["i"], F.lit(64), F.lit(64))
    assert out.agg(F.sum(F.col("x1") - F.col("x0"))).head()[0] == 5 * 400
    assert sum(n for name, n in sizes.items() if name != "united") <= 5


def test_mask_work_is_dealt_out(spark):
    """Masks are few bytes in a file, but much work: no query of theirs leaves them to one task."""
    d = "/root/testdata/sf0.001"
    assert min(q.rdd.getNumPartitions() for q in (Q.holed(spark, d), Q.q_mask_decode(spark, d), Q.q_mask_turn(spark, d))) >= 4


def test_numbers_of_lists(spark):
    """What is read from the text at once is what each element says."""
    texts = ['[1,"x",2.5,null]', '[1,true,"3",[1]]', "[]", "[1e30,-2.5E-3,12345678901234567890123]", "7", '{"a":1}', '["NaN"]', "[[1,2],[3]]", '[[1,2],[3,"x"],[]]', "[[1],2,[3]]", "[[[1]]]"]
    v = F.try_parse_json("s")
    each = F.transform(P.as_list(v), P.number), F.transform(P.as_list(v), lambda r: F.transform(P.as_list(r), P.number))
    for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", each[0], P.numbers(v), each[1], P.number_rows(v)).collect():
        assert str(r[1]) == str(r[2]) and str(r[3]) == str(r[4]), r.s


# ------------------------------------------------------------------------------------------------------------- images


def interlaced(levels):
    """A grey image in seven passes without filters."""
    h, w = levels.shape
    rows = b"".join(b"\0" + levels[y, x::dx].tobytes() for x, y0, dx, dy in png.PASSES if x < w for y in range(y0, h, dy))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("h,w", [(1, 1), (5, 7), (12, 17), (8, 8), (2, 33)])
def test_png_of_every_kind(h, w):
    levels = RNG.integers(0, 256, (h, w), dtype=np.uint8)
    luma = lambda c: ((c.astype(int) @ png.LUMA + 32768) >> 16).astype(np.uint8)
    assert (png.grey(interlaced(levels)) == levels).all()
    for depth in (1, 2, 4, 8, 16):
        own = levels if depth == 16 else levels >> (8 - depth)
        want = levels if depth >= 8 else own * (255 // ((1 << depth) - 1))
        assert (png.grey(png.encoded(own[:, :, None], 0, depth)) == want).all()
    table = RNG.integers(0, 256, (16, 3), dtype=np.uint8)
    assert (png.grey(png.encoded((levels >> 4)[:, :, None], 3, 4, table)) == luma(table[levels >> 4])).all()
    rgba = RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)
    for depth in (8, 16):
        assert (png.grey(png.encoded(rgba, 6, depth)) == luma(rgba[:, :, :3])).all()
        assert (png.grey(png.encoded(rgba[:, :, :3], 2, depth)) == luma(rgba[:, :, :3])).all()
        assert (png.grey(png.encoded(rgba[:, :, :2], 4, depth)) == rgba[:, :, 0]).all()


def test_broken_png():
    good = png.encoded(np.arange(48, dtype=np.uint8).reshape(6, 8, 1))
    rng = np.random.default_rng(1)
    for cut in range(len(good)):
        with pytest.raises(ValueError):
            png.grey(good[:cut])
    for _ in range(300):
        bad = bytearray(good)
        bad[rng.integers(len(bad))] ^= int(rng.integers(1, 256))
        with pytest.raises(ValueError):
            png.grey(bytes(bad))
    huge = bytearray(good)
    huge[16:24] = struct.pack(">II", 1 << 30, 1 << 30)
    huge[29:33] = struct.pack(">I", zlib.crc32(bytes(huge[12:29])))
    with pytest.raises(ValueError):
        png.grey(bytes(huge))


# ---------------------------------------------------------------------------------------------------------- encodings


def decoded(spark, values, w=17, h=12, canvas=None):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, mask string")
    cw, ch = canvas or (w, h)
    rows = E.with_decoded(df, "mask", "d", F.lit(cw), F.lit(ch), F.lit(w), F.lit(h), F.lit(0.5)).orderBy("i").collect()
    return [([r.asDict() for r in x.d.runs] if x.d.runs is not None else None, x.d.failed, x.d.unknown) for x in rows]


def test_encodings_agree(spark):
    m = MASKS[0]
    counts = lambda v: np.diff([0, *np.flatnonzero(np.diff(np.concatenate(([0], v.astype(int))))).tolist(), v.size]).tolist()
    text = lambda b: base64.b64encode(b).decode()
    f, size = counts(m.T.ravel()), [12, 17]
    levels = (m * 255).astype(np.uint8)
    image = png.encoded(levels[:, :, None])
    values = [
        {"size": size, "counts": f}, {"size": size, "counts": M.leb_encode(f)}, {"shape": size, "counts": counts(m.ravel()), "order": "c"}, {"counts": f}, {"size": size, "counts": [f[0], 0, 0, *f[1:]]},
        m.astype(float).tolist(), (m * 200).tolist(), m.astype(int).ravel().tolist(), {"mask": m.astype(int).tolist()}, {"segmentation": {"data": {"size": size, "counts": f}}},
        {"base64": text(levels.tobytes()), "size": size}, text(levels.tobytes()), text(image), {"png": text(image)}, {"mask": "data:image/png;base64," + text(image)}, {"base64": text(image), "size": [3, 3]},
    ]
    for k, got in enumerate(decoded(spark, values)):
        assert got == (M.to_runs(m), False, False), k
    small = decoded(spark, values, canvas=(9, 5))
    assert all(got == (M.to_runs(nearest(m, 9, 5)), False, False) for got in small)


def test_rings_agree(spark):
    flat = [1, 1, 9, 1, 9, 9, 1, 9]
    pairs = [[1, 1], [9, 1], [9, 9], [1, 9]]
    values = [flat, [flat], [pairs], [[{"x": 1, "y": 1}, {"x": 9, "y": 1}, {"x": 9, "y": 9}, {"x": 1, "y": 9}]], {"polygons": [[*flat, 7]]}]
    got = decoded(spark, [*values, [flat, [3, 3, 5, 3, 5, 5, 3, 5]]])
    assert all(g == got[0] for g in got[:5]) and not got[0][1] and sum(r["x1"] - r["x0"] for r in got[0][0]) == 64
    assert sum(r["x1"] - r["x0"] for r in got[5][0]) == 60


def test_odd_masks(spark):
    unknown = [{}, [], "?", "", {"png": "iVBORw0KGgo="}, [1, 2, 3], {"nothing": 1}, 7, [{"x": 1}], {"mask": None}]
    failed = [{"counts": "abc"}, {"counts": [1, "x"]}, {"counts": None}, {"counts": [1, -1]}, {"size": [0, 0], "counts": [1]}, [["a", 1, 2, 3, 4, 5]], [1, "x", 3, 4, 5, 6]]
    got = decoded(spark, [*unknown, *failed])
    assert [g[1:] for g in got[: len(unknown)]] == [(False, True)] * len(unknown)
    assert [g[1:] for g in got[len(unknown) :]] == [(True, False)] * len(failed)
    nothing = spark.createDataFrame([(None,)], "mask string")
    d = E.with_decoded(nothing, "mask", "d", F.lit(4), F.lit(4), F.lit(4), F.lit(4), F.lit(0.5)).head().d
    assert (d.runs, d.failed, d.unknown) == (None, False, False)
