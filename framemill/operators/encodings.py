"""Masks as payloads hold them: a column expression tells the encoding and takes its parts out, then one kernel an encoding makes runs.

    counts   {"counts": [...] or compressed text, "size": [h, w], "order": "F" or "C"}
    rings    [[x, y, ...], ...], [[[x, y], ...], ...], [[{"x":, "y":}, ...], ...], or one flat [x, y, ...]
    levels   rows of numbers as large as the image, or all its numbers in one list
    image    base64 text, plain or under base64 or png: raw bytes if as many as the size says, else a PNG image

Any of them may lie under mask, segmentation, polygons, polygon, contours or data, up to MAX_NESTED deep.

Defined: null and empty values, and text that is no image, are unknown; a known encoding with numbers missing or broken has failed.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import png
from ..sources.payload import as_list, as_map, let, number, number_rows, numbers, parsed
from . import runs as N
from .masks import RUNS, edges, fill_runs, leb_decode

#: Names under which payloads nest masks, and hold images.
NESTS, IMAGES = ["mask", "segmentation", "polygons", "polygon", "contours", "data"], ["base64", "png", "data"]
MAX_NESTED = 4
PARTS = "struct<kind:string,h:bigint,w:bigint,rows:array<array<double>>,text:string>"


def _member(v: Column, name: str) -> Column:
    """A member of an object, null for anything else; no member is copied but this one."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _inner(v: Column) -> Column:
    """What an object without counts nests, else the value itself."""
    return F.coalesce(F.when(_member(v, "counts").isNull(), F.coalesce(*[_member(v, n) for n in NESTS])), v)


def _numbers(v: Column) -> Column:
    """The numbers of a ring, be they flat, in pairs or in objects (a missing x or y is 0); an odd last one is left out."""
    flat = lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - F.size(a) % 2), number)
    pairs = lambda a: F.flatten(F.transform(a, lambda p: let(as_list(p), lambda q: F.array(number(F.get(q, F.lit(0))), number(F.get(q, F.lit(1)))))))
    side = lambda m, n: F.when(F.map_contains_key(m, F.lit(n)), number(F.try_element_at(m, F.lit(n)))).otherwise(0.0)
    objects = lambda a: F.flatten(F.transform(a, lambda p: let(as_map(p), lambda m: F.array(side(m, "x"), side(m, "y")))))
    head = lambda a: F.get(a, F.lit(0))
    return let(as_list(v), lambda a: F.when(as_map(head(a)).isNotNull(), objects(a)).when(F.size(as_list(head(a))) > 1, pairs(a)).otherwise(flat(a)))


def parts(text: Column, width: Column, height: Column) -> Column:
    """Kind, size, numbers and text of a mask in JSON on an image of width x height; a null kind is unknown."""
    w, h = width.cast("bigint"), height.cast("bigint")
    none = F.lit(None).cast("array<array<double>>")
    make = lambda kind, hh, ww, rows, t: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), hh.cast("bigint").alias("h"), ww.cast("bigint").alias("w"), rows.alias("rows"), t.cast("string").alias("text"))
    no_text = F.lit(None)

    def sized(m: Column, f) -> Column:
        size = F.coalesce(*[F.when(F.size(as_list(_member(m, n))) > 1, as_list(_member(m, n))) for n in ("size", "shape")])
        return let(size, lambda s: f(F.when(s.isNotNull(), number(F.get(s, F.lit(0)))), F.when(s.isNotNull(), number(F.get(s, F.lit(1))))))

    def of_object(m: Column) -> Column:
        counts = _member(m, "counts")
        order = F.upper(F.coalesce(F.try_variant_get(_member(m, "order"), "$", "string"), F.lit("F")))
        kind = F.when(order == "F", "counts").otherwise("counts by row")
        of = lambda c: sized(m, lambda hh, ww: make(kind, F.coalesce(hh, h), F.coalesce(ww, w), F.when(c.isNotNull(), F.array(c)), F.when(c.isNull(), F.try_variant_get(counts, "$", "string"))))
        runs = let(numbers(counts), of)
        image = F.coalesce(*[F.when(F.schema_of_variant(_member(m, n)) == "STRING", F.try_variant_get(_member(m, n), "$", "string")) for n in IMAGES])
        return F.when(counts.isNotNull(), runs).when(image.isNotNull(), sized(m, lambda hh, ww: make("image", hh, ww, none, image)))

    def of_list(v: Column, a: Column) -> Column:
        head, n = F.get(a, F.lit(0)), F.size(a)
        inner = as_list(head)
        nested = as_list(F.get(inner, F.lit(0))).isNotNull() | as_map(F.get(inner, F.lit(0))).isNotNull()
        rings = nested | ~((n == h) & (F.size(inner) == w))
        rows = make("levels", h, w, number_rows(v), no_text)
        plain = numbers(v)
        flat = F.when((n >= 6) & (n % 2 == 0) & (n != w * h), make("rings", h, w, F.array(plain), no_text)).when(n == w * h, make("levels", h, w, F.array(plain), no_text))
        return F.when(F.size(inner) > 0, F.when(rings, make("rings", h, w, F.transform(a, _numbers), no_text)).otherwise(rows)).when(number(head).isNotNull(), flat)

    def tagged(v: Column) -> Column:
        alone = F.when(F.schema_of_variant(v) == "STRING", make("image", h, w, none, F.try_variant_get(v, "$", "string")))
        return F.coalesce(of_object(v), let(as_list(v), lambda a: of_list(v, a)), alone).cast(PARTS)

    v = parsed(text)
    for _ in range(MAX_NESTED):
        v = let(v, _inner)
    return let(v, tagged)


# ------------------------------------------------------------------------------------ kernels: parts to runs, w and h


def _of_counts(counts: list[np.ndarray], h: np.ndarray, w: np.ndarray, by_row: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mask, y, x0 and x1 of many masks, whose counts hold neither less than 0 nor NaN."""
    n, total = np.array([len(c) for c in counts], dtype=np.int64), h * w
    mask = np.repeat(np.arange(len(counts)), n)
    each = np.minimum(np.concatenate([*counts, np.zeros(0)]), np.maximum(total, 0)[mask]).astype(np.int64)
    upto, start = np.cumsum(each), np.cumsum(n) - n
    ends = np.minimum(upto - np.append(0, upto)[start][mask], total[mask])
    second = np.flatnonzero((np.arange(len(mask)) - start[mask]) % 2 == 1)
    a, b, mask = ends[second - 1], ends[second], mask[second]
    some = b > a
    a, b, mask = a[some], b[some], mask[some]
    length = (w if by_row else h)[mask]
    lines = N.cut_lines(a, b, length)
    mask = np.repeat(mask, (b - 1) // length - a // length + 1)
    # a count of 0 lets spans touch; turning tells longest runs anyhow, so rows are turned twice
    return N.turned_each(*N.turned_each(mask, *lines)) if by_row else N.turned_each(mask, *lines)


def _of_rings(rows: list[np.ndarray], w: float, h: float, canvas: tuple[int, int]) -> tuple[tuple, int, int]:
    rings = [r[: len(r) // 2 * 2].reshape(-1, 2) * np.array([canvas[0] / w, canvas[1] / h]) for r in rows]
    if any(np.isnan(r).any() for r in rings):
        raise ValueError("a ring holds something that is no number")
    return fill_runs(rings, *canvas), *canvas


def _of_levels(rows: list[np.ndarray], w: float, h: float, threshold: float) -> tuple[tuple, int, int]:
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in length")
    m = np.concatenate(rows).astype(np.float32).reshape(int(h), int(w))
    if np.isnan(m).any():
        raise ValueError("a level is no number")
    return edges(m > (threshold if m.max() <= 1 + 1e-6 else threshold * 255)), m.shape[1], m.shape[0]


def _of_image(text: str, w: float, h: float, threshold: float) -> tuple[tuple, int, int] | None:
    head, comma, rest = text.partition(",")
    try:
        data = base64.b64decode(rest if comma and len(head) < 64 and text.lstrip().startswith("data:") else text)
        known = not np.isnan(h) and not np.isnan(w) and len(data) == h * w
        m = np.frombuffer(data, np.uint8).reshape(int(h), int(w)) if known else png.grey(data)
    except ValueError:
        return None  # text that is no image says nothing
    return edges(m > threshold * 255), m.shape[1], m.shape[0]


def _counts_of(rows: list[np.ndarray], text: str | None, w: float, h: float) -> np.ndarray:
    counts = rows[0] if rows is not None else np.array(leb_decode(text), dtype=np.float64)
    if not int(h) or not int(w) or np.isnan(counts).any() or (counts < 0).any():
        raise ValueError("counts and a size are needed")
    return counts


def made(part: pa.StructArray, canvas: np.ndarray, threshold: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """(mask, y, x0, x1) of the runs of parts, their widths and heights (0 where nothing was made), and which have failed."""
    kinds, text = (pc.struct_field(part, [c]).to_pylist() for c in ("kind", "text"))
    hs, ws = (pc.cast(pc.struct_field(part, [c]), pa.float64()).to_numpy(zero_copy_only=False) for c in ("h", "w"))
    lists = pc.struct_field(part, ["rows"])
    none, at, inner = pc.is_null(lists).to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.values
    cut, numbers = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
    gone = pc.is_null(inner).to_numpy(zero_copy_only=False)

    def rows(i: int) -> list[np.ndarray] | None:
        if none[i]:
            return None
        if gone[at[i] : at[i + 1]].any():
            raise ValueError("a row is no list")
        return [numbers[cut[k] : cut[k + 1]] for k in range(at[i], at[i + 1])]

    found, w, h, failed = [], np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), bool)
    counted: dict[bool, dict[int, np.ndarray]] = {False: {}, True: {}}
    for i, kind in enumerate(kinds):
        try:
            if kind in ("counts", "counts by row"):
                counted[kind == "counts by row"][i] = _counts_of(rows(i), text[i], ws[i], hs[i])
                w[i], h[i] = ws[i], hs[i]
            elif kind is not None:
                size = (ws[i], hs[i])
                one = _of_image(text[i], *size, threshold[i]) if kind == "image" else _of_rings(rows(i), *size, tuple(canvas[i].tolist())) if kind == "rings" else _of_levels(rows(i), *size, threshold[i])
                if one is not None:
                    (y, a, b), w[i], h[i] = one
                    found.append((np.full(len(y), i), y, a, b))
        except (ArithmeticError, IndexError, TypeError, ValueError):
            failed[i] = True
    for by_row, counts in counted.items():
        if counts:
            own = np.array(list(counts))
            mask, *sides = _of_counts(list(counts.values()), h[own], w[own], by_row)
            found.append((own[mask], *sides))
    every = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(4)]
    order = np.argsort(every[0], kind="stable")
    return tuple(v[order] for v in every), w, h, failed


def _made():
    @arrow_udf(f"struct<runs:{RUNS},w:int,h:int,failed:boolean>")
    def run(part: pa.Array, ww: pa.Array, wh: pa.Array, threshold: pa.Array) -> pa.Array:
        canvas = np.stack([pc.fill_null(v, 0).to_numpy(zero_copy_only=False) for v in (ww, wh)], axis=1)
        limit, out = threshold.to_numpy(zero_copy_only=False), []
        for k in N.in_chunks(len(part)):
            runs, w, h, failed = made(part[k.start : k.stop], canvas[k], limit[k])
            none = w == 0
            sizes = [pa.array(v, pa.int32(), mask=none) for v in (w, h)]
            out.append(pa.StructArray.from_arrays([N.masks(len(w), *runs, none), *sizes, pa.array(failed)], names=["runs", "w", "h", "failed"]))
        return pa.concat_arrays(out)

    return run.asNondeterministic()  # so it is computed once, not inlined into the expressions that use it


def with_decoded(df: DataFrame, mask: str, out: str, work_w: Column, work_h: Column, image_w: Column, image_h: Column, threshold: Column) -> DataFrame:
    """df with out: runs on the working canvas (null if empty), failed and unknown of the JSON masks in a column.

    Runs of another size than the canvas are moved to it in column expressions.
    """
    m = F.col("_made")
    # a generator of one row: the kernel then reads a column, for it can't take an expression with lambdas in lambdas
    rows = df.withColumn("_parts", F.explode(F.array(parts(F.col(mask), image_w, image_h)))).withColumn("_made", _made()(F.col("_parts"), work_w.cast("int"), work_h.cast("int"), threshold.cast("double")))
    moved = N.resampled(m["runs"], m["w"], m["h"], work_w.cast("int"), work_h.cast("int"))
    unknown = F.col(mask).isNotNull() & (m["w"].isNull() & ~m["failed"])
    rows = rows.withColumn(out, F.struct(F.when(F.size(moved) > 0, moved).alias("runs"), m["failed"].alias("failed"), unknown.alias("unknown")))
    return rows.drop("_parts", "_made")
