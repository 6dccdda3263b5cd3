"""Runs without bitmaps: other axis, other size, holes; and masks as relations of runs, so that one may span tiles and tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

#: Columns a run takes part in when it looks for neighbours in the next row; it only bounds what one cell holds.
CELL = 256
#: Masks that are turned at once.
CHUNK = 256

# ----------------------------------------------------------------------------------------------------- one mask


def arrays(runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.array([(r["y"], r["x0"], r["x1"]) for r in runs if r["x1"] > r["x0"]] if runs is not None else [], dtype=np.int64).reshape(-1, 3)
    return v[:, 0], v[:, 1], v[:, 2]


def listed(y, a, b) -> list[dict]:
    return [{"y": i, "x0": p, "x1": q} for i, p, q in zip(y.tolist(), a.tolist(), b.tolist())]


def turned(line: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals [a, b) of lines as longest intervals of the lines that cross them, in order."""
    return turned_each(np.zeros_like(line), line, a, b)[1:]


def turned_each(mask: np.ndarray, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """turned() of many masks at once; mask rises.

    A sweep over the places where a line differs from the one before: there a crossing interval begins or ends. Takes
    memory of the intervals on both sides, whatever the canvas.
    """
    if not len(line):
        return mask, line, a, b
    w, s = int(b.max()) + 1, int(line.max()) + 2
    row = mask * s + line
    # an interval that the next line has too begins and ends nothing between them
    n = np.diff(np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))))
    below = np.arange(len(row)) + np.repeat(n, n)
    near = np.minimum(below, len(row) - 1)
    goes_on = (below < len(row)) & (row[near] == row + 1) & (a[near] == a) & (b[near] == b)
    first = np.ones(len(row), bool)
    first[below[goes_on]] = False
    top, end = row[first] * w, (row[~goes_on] + 1) * w
    one, two = np.ones(len(top), np.int64), np.ones(len(end), np.int64)
    key = np.concatenate((top + a[first], top + b[first], end + a[~goes_on], end + b[~goes_on]))
    order = np.argsort(key, kind="stable")
    key, level = key[order], np.cumsum(np.concatenate((one, -one, -two, two))[order])
    last = np.append(key[1:] != key[:-1], True)
    key, level = key[last], level[last]

    def cells(sign: int) -> np.ndarray:
        """Mask, crossing line and place of the cells where something begins (1) or ends (-1), sorted."""
        k = np.flatnonzero(level == sign)
        n = key[k + 1] - key[k]
        r, x = np.divmod(key[k], w)
        m, y = np.divmod(r, s)
        x = np.repeat(x - np.cumsum(n) + n, n) + np.arange(n.sum())
        m, y = np.repeat(m, n), np.repeat(y, n)
        return np.stack((m, x, y))[:, np.argsort((m * w + x) * s + y, kind="stable")]

    begin, stop = cells(1), cells(-1)
    return begin[0], begin[1], begin[2], stop[2]


def cut_lines(a: np.ndarray, b: np.ndarray, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [a, b) of a flat sequence as intervals of lines of the given length (one, or one a span); spans aren't empty."""
    first = a // length
    n = (b - 1) // length - first + 1
    line = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    length = np.repeat(np.broadcast_to(length, n.shape), n)
    return line, np.maximum(np.repeat(a, n) - line * length, 0), np.minimum(np.repeat(b, n) - line * length, length)


def columns(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mask (its place in the array), y, x0 and x1 of all runs of an array of masks, without empty ones."""
    n = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    flat = runs.flatten()
    y, a, b = (pc.struct_field(flat, [c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1"))
    some = b > a
    return np.repeat(np.arange(len(runs)), n)[some], y[some], a[some], b[some]


def lists(n: np.ndarray, values: pa.Array, none: np.ndarray | None = None) -> pa.ListArray:
    """An array of lists of n values each; none marks those that are null."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values, mask=None if none is None else pa.array(none))


def masks(n: int, mask: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, none: np.ndarray | None = None) -> pa.ListArray:
    """columns() undone, for n masks."""
    values = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (y, a, b)], names=["y", "x0", "x1"])
    return lists(np.bincount(mask, minlength=n), values, none)


def in_chunks(size: int):
    """Slices of so many masks that a sweep's arrays stay small."""
    return [slice(k, min(k + CHUNK, size)) for k in range(0, max(size, 1), CHUNK)]


def gaps(runs: list[dict], w: int, h: int) -> list[dict]:
    """The background's runs."""
    out, k = [], 0
    for y in range(h):
        at = 0
        while k < len(runs) and runs[k]["y"] == y:
            if runs[k]["x0"] > at:
                out.append({"y": y, "x0": at, "x1": runs[k]["x0"]})
            at, k = runs[k]["x1"], k + 1
        if at < w:
            out.append({"y": y, "x0": at, "x1": w})
    return out


def joined(runs: list[dict]) -> list[dict]:
    """Runs in order, those that touch as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["y"], r["x0"])):
        if out and out[-1]["y"] == r["y"] and out[-1]["x1"] >= r["x0"]:
            out[-1]["x1"] = max(out[-1]["x1"], r["x1"])
        else:
            out.append({"y": r["y"], "x0": r["x0"], "x1": r["x1"]})
    return out


def resampled(runs: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """Runs on a canvas of another size: a pixel is what lies under its middle, so an interval's ends move and rows repeat or go."""
    cut = lambda v, n, k: F.call_function("div", 2 * v.cast("bigint") * k + n - 1, 2 * n.cast("bigint")).cast("int")
    none = F.array().cast("array<struct<y:int,x0:int,x1:int>>")

    def rows(r: Column) -> Column:
        y0, y1, x0, x1 = cut(r["y"], h, to_h), cut(r["y"] + 1, h, to_h), cut(r["x0"], w, to_w), cut(r["x1"], w, to_w)
        return F.when((y1 > y0) & (x1 > x0), F.transform(F.sequence(y0, F.greatest(y1 - 1, y0)), lambda y: F.struct(y.alias("y"), x0.alias("x0"), x1.alias("x1")))).otherwise(none)

    def merged(s: Column) -> Column:
        apart = lambda p, q: p.isNull() | q.isNull() | (p["y"] != q["y"]) | (p["x1"] < q["x0"])
        first = F.filter(s, lambda r, i: apart(F.when(i > 0, F.get(s, i - 1)), r))
        last = F.filter(s, lambda r, i: apart(r, F.get(s, i + 1)))
        return F.zip_with(first, last, lambda p, q: F.struct(p["y"].alias("y"), p["x0"].alias("x0"), q["x1"].alias("x1")))

    moved = F.get(F.transform(F.array(F.array_sort(F.flatten(F.transform(runs, rows)))), merged), F.lit(0))
    return F.when((w == to_w) & (h == to_h), runs).otherwise(moved)


# ------------------------------------------------------------------------------------------ masks as relations of runs


def exploded(masks: DataFrame, key: list[str], x: str | None = None, y: str | None = None) -> DataFrame:
    """A row a run: key, y, x0, x1. x and y name columns with a tile's place in the whole mask."""
    dx, dy = (F.col(c) if c else F.lit(0) for c in (x, y))
    return masks.select(*key, dx.alias("_dx"), dy.alias("_dy"), F.explode("runs").alias("r")).select(*key, (F.col("r.y") + F.col("_dy")).cast("int").alias("y"), (F.col("r.x0") + F.col("_dx")).cast("int").alias("x0"), (F.col("r.x1") + F.col("_dx")).cast("int").alias("x1")).where("x1 > x0")


def united(runs: DataFrame, key: list[str]) -> DataFrame:
    """The union of runs as disjoint longest ones, by row: a run begins where none before reaches."""
    before = Window.partitionBy(*key, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, 0)
    islands = runs.withColumn("_new", F.coalesce((F.col("x0") > F.max("x1").over(before)).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(upto))
    return islands.groupBy(*key, "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def _links(runs: DataFrame, key: list[str], diagonal: bool) -> DataFrame:
    """Neighbours a < b of disjoint runs (key, id, y, x0, x1): in rows that follow each other, or at one place of a row."""
    reach = 0 if diagonal else 1
    cells = runs.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("x0") - 1) / CELL), F.floor(F.col("x1") / CELL))))
    side = lambda s, *c: cells.select(*key, F.col("id").alias(s), *c, F.col("x0").alias(f"{s}0"), F.col("x1").alias(f"{s}1"), "_cell")
    below = side("a", "y").join(side("b", (F.col("y") - 1).alias("y")), [*key, "y", "_cell"])
    below = below.where((F.col("a0") + reach <= F.col("b1")) & (F.col("b0") + reach <= F.col("a1")))
    beside = runs.select(*key, "y", F.col("x1").alias("_x"), F.col("id").alias("a")).join(runs.select(*key, "y", F.col("x0").alias("_x"), F.col("id").alias("b")), [*key, "y", "_x"])
    return below.select("a", "b").union(beside.select("a", "b"))


def _closed(links: DataFrame) -> DataFrame:
    """(id, root): every linked node with the least one it reaches. Stars are rewired until nothing changes, in rounds of the logarithm of the longest chain."""
    links = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = links.union(links.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = saved(small, "small")
        same = links.count() == small.count() and links.join(small, ["u", "v"], "left_anti").isEmpty()
        links = small
        if same:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))


def components(runs: DataFrame, key: list[str], diagonal: bool = True) -> DataFrame:
    """Disjoint runs with the component of each: (cy, cx), the first pixel of its part of the mask in raster order.

    Runs are nodes, neighbours meet by joins, and the closure is a few rounds of joins: a mask may be of any size, and
    its runs may come from tiles, whose borders cut runs in two.
    """
    named = saved(runs.select(*key, "y", "x0", "x1", F.struct(*key, "y", "x0").alias("id")), "runs")
    roots = _closed(_links(named, key, diagonal))
    root = F.coalesce("root", "id")
    return named.join(roots, "id", "left").select(*key, "y", "x0", "x1", root["y"].alias("cy"), root["x0"].alias("cx"))


def _gaps(rows: DataFrame, key: list[str], width: Column, height: Column) -> DataFrame:
    """Rectangles (key, y0, y1, x0, x1) of the background between two runs of a row, as high as nothing changes; open: whether it
    lies at the border, or meets an empty row or the background beside all runs of the row above or below. Ends are exclusive."""
    w, h = width.cast("int"), height.cast("int")
    between = rows.where("_from is not null").select(*key, "y", F.col("_from").alias("x0"), F.col("x0").alias("x1"))
    n = F.row_number().over(Window.partitionBy(*key, "x0", "x1").orderBy("y"))
    rects = between.withColumn("_band", F.col("y") - n).groupBy(*key, "x0", "x1", "_band").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).drop("_band")
    ends = rows.where("_from is null")
    for side, at in (("_above", F.col("y") + 1), ("_below", F.col("y"))):
        row = ends.select(*key, at.alias("y0" if side == "_above" else "y1"), F.struct(F.col("x0").alias("first"), F.col("_end").alias("last")).alias(side))
        rects = rects.join(row, [*key, "y0" if side == "_above" else "y1"], "left")
    meets = lambda r: r.isNull() | ((r["first"] > 0) & (F.col("x0") <= r["first"])) | ((r["last"] < w) & (F.col("x1") >= r["last"]))
    border = (F.col("y0") <= 0) | (F.col("y1") >= h) | (F.col("x0") <= 0) | (F.col("x1") >= w)
    return rects.select(*key, "y0", "y1", "x0", "x1", (border | meets(F.col("_above")) | meets(F.col("_below"))).alias("open"))


def without_holes(runs: DataFrame, key: list[str], width: Column, height: Column) -> DataFrame:
    """The union of runs with the background that touches no border of its canvas (width and height: expressions of the key's columns).

    Only what lies between two runs of a row can be closed. Its equal rows are one rectangle, those that meet are closed by
    joins, and a part is open if one of its rectangles is or meets one that is.
    """
    row = Window.partitionBy(*key, "y")
    rows = united(runs, key).withColumns({"_from": F.lag("x1").over(row.orderBy("x0")), "_end": F.max("x1").over(row)})
    rows = saved(rows.select(*key, "y", "x0", "x1", "_from", "_end"), "united")
    rects = saved(_gaps(rows, key, width, height).withColumn("id", F.struct(*key, "y0", "x0")), "gaps")
    cells = rects.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("x0") - 1) / CELL), F.floor(F.col("x1") / CELL))))
    side = lambda s, y: cells.select(*key, F.col(y).alias("y"), "_cell", F.col("id").alias(s), F.col("open").alias(f"{s}_open"), F.col("x0").alias(f"{s}0"), F.col("x1").alias(f"{s}1"))
    # where one row's background ends, what it meets below begins: else the two would touch within a row
    met = side("a", "y1").join(side("b", "y0"), [*key, "y", "_cell"]).where("a0 <= b1 and b0 <= a1 and not (a_open and b_open)")
    met = saved(met.select("a", "b", "a_open", "b_open"), "met")
    holes = rects.where("not open")
    if not met.isEmpty():
        roots = _closed(met.where("not a_open and not b_open").select("a", "b"))
        holes = holes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        seen = met.where("a_open").select(F.col("b").alias("id")).union(met.where("b_open").select(F.col("a").alias("id"))).distinct()
        holes = holes.join(holes.join(seen, "id", "left_semi").select("root").distinct(), "root", "left_anti")
    filled = holes.select(*key, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")
    return united(rows.select(*key, "y", "x0", "x1").union(filled), key)
