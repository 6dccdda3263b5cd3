"""Column functions over boxes, keypoints and row-run masks. A box is a struct x1, y1, x2, y2 of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the COCO keypoint layout.
COCO17_NAMES = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
COCO17_SIGMAS = [0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089]
COCO17_SKELETON = [(15, 13), (13, 11), (16, 14), (14, 12), (11, 12), (5, 11), (6, 12), (5, 6), (5, 7), (6, 8), (7, 9), (8, 10), (1, 2), (0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
COCO17_ANGLES = [("left_elbow", (5, 7, 9)), ("right_elbow", (6, 8, 10)), ("left_shoulder", (7, 5, 11)), ("right_shoulder", (8, 6, 12)), ("left_hip", (5, 11, 13)), ("right_hip", (6, 12, 14)), ("left_knee", (11, 13, 15)), ("right_knee", (12, 14, 16))]
DEFAULT_SIGMA = 0.05


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))])


def box_or_zero(b: Column) -> Column:
    return F.coalesce(b, box(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / F.when(union > 0, union)).otherwise(F.lit(0.0))


def to_xywh(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def from_list(v: Column, fmt: Column) -> Column:
    """A box from four numbers; format auto takes x, y, width, height where the corners don't ascend."""
    a, b, c, d = (F.get(v, F.lit(i)) for i in range(4))
    auto = F.when((c <= a) | (d <= b), "xywh").otherwise("xyxy")
    kind = F.when(fmt.isin("xyxy", "xywh", "cxcywh"), fmt).otherwise(auto)
    return F.when(F.size(v) >= 4, F.when(kind == "xyxy", box(a, b, c, d)).when(kind == "xywh", box(a, b, a + c, b + d)).otherwise(box(a - c / 2, b - d / 2, a + c / 2, b + d / 2)))


def auto_format(v: Column) -> Column:
    return F.when((F.get(v, F.lit(2)) <= F.get(v, F.lit(0))) | (F.get(v, F.lit(3)) <= F.get(v, F.lit(1))), "xywh").otherwise("xyxy")


def clip(b: Column, w: Column, h: Column) -> Column:
    side = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    return box(side(b["x1"], w), side(b["y1"], h), side(b["x2"], w), side(b["y2"], h))


def rounded(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


# ------------------------------------------------------------------------------------------------------- keypoints


def parse_flat(v: Column) -> Column:
    """Keypoints from flat numbers: triplets where the count allows, else pairs with score 1; COCO visibility mapped."""
    point = lambda i, n: F.struct(F.get(v, (i * n).cast("int")).alias("x"), F.get(v, (i * n + 1).cast("int")).alias("y"), (F.get(v, (i * n + 2).cast("int")) if n == 3 else F.lit(1.0)).alias("score"))
    steps = lambda n: F.when(F.size(v) >= n, F.sequence(F.lit(0), (F.size(v) / n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    triplets = F.transform(steps(3), lambda i: point(i, 3))
    coco = F.forall(triplets, lambda k: k["score"].isin(0.0, 1.0, 2.0)) & F.exists(triplets, lambda k: k["score"] == 2.0)
    mapped = F.transform(triplets, lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), (k["score"] / 2).alias("score")))
    return F.when(F.size(v) % 3 == 0, F.when(coco, mapped).otherwise(triplets)).when(F.size(v) % 2 == 0, F.transform(steps(2), lambda i: point(i, 2)))


def hide_below(kps: Column, threshold: float) -> Column:
    return F.transform(kps, lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.when(k["score"] < threshold, 0.0).otherwise(k["score"]).alias("score")))


def visible(kps: Column) -> Column:
    return F.filter(kps, lambda k: k["score"] > 0)


def hull(kps: Column, padding: float = 0.0) -> Column:
    seen = visible(kps)
    edge = lambda f, n: f(F.transform(seen, lambda k: k[n]))
    x1, x2, y1, y2 = edge(F.array_min, "x"), edge(F.array_max, "x"), edge(F.array_min, "y"), edge(F.array_max, "y")
    px, py = (x2 - x1) * padding, (y2 - y1) * padding
    return F.when(F.size(seen) > 0, box(x1 - px, y1 - py, x2 + px, y2 + py))


def pose_area(given: Column, kps: Column) -> Column:
    return F.when(area(given) > 0, area(given)).when(F.size(visible(kps)) > 0, F.greatest(area(hull(kps)), F.lit(1.0))).otherwise(1.0)


def oks(a: Column, b: Column, area_a: Column, area_b: Column, sigmas: list[float] | Column = COCO17_SIGMAS) -> Column:
    """Object keypoint similarity over joints visible in both, averaged over the two areas; 0 without such joints."""
    s = sigmas if isinstance(sigmas, Column) else F.array(*[F.lit(float(x)) for x in sigmas])
    joint = F.zip_with(a, b, lambda p, q: F.when((p["score"] > 0) & (q["score"] > 0), (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    var = F.transform(joint, lambda d, i: F.struct(d.alias("d"), F.pow(2 * F.coalesce(F.get(s, i), F.lit(DEFAULT_SIGMA)), F.lit(2.0)).alias("v")))
    both = F.filter(var, lambda z: z["d"].isNotNull())
    mean = lambda ar: F.aggregate(both, F.lit(0.0), lambda acc, z: acc + F.exp(-z["d"] / (z["v"] * F.greatest(ar, F.lit(1.0)) * 2))) / F.size(both)
    return F.when(F.size(both) > 0, (mean(area_a) + mean(area_b)) / 2).otherwise(F.lit(0.0))


def angle(kps: Column, a: int, v: int, b: int) -> Column:
    p, q, r = (F.get(kps, F.lit(i)) for i in (a, v, b))
    ux, uy, wx, wy = p["x"] - q["x"], p["y"] - q["y"], r["x"] - q["x"], r["y"] - q["y"]
    length = F.sqrt(ux * ux + uy * uy) * F.sqrt(wx * wx + wy * wy)
    cos = (ux * wx + uy * wy) / F.when(length > 0, length)
    return F.when((p["score"] > 0) & (q["score"] > 0) & (r["score"] > 0), F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))))


def angles(kps: Column, triples=COCO17_ANGLES) -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.bround(angle(kps, *t), 2).alias("value")) for n, t in triples])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def blend(cur: Column, prev: Column, alpha: float, max_jump: float | None = None) -> Column:
    """Exponential smoothing of positions where both joints are visible and near enough; scores are kept."""

    def joint(c, p):
        far = F.sqrt((c["x"] - p["x"]) * (c["x"] - p["x"]) + (c["y"] - p["y"]) * (c["y"] - p["y"]))
        on = (c["score"] > 0) & (p["score"] > 0) & (F.lit(True) if max_jump is None else far <= max_jump)
        mixed = lambda n: F.when(on, alpha * c[n] + (1 - alpha) * p[n]).otherwise(c[n]).alias(n)
        return F.struct(mixed("x"), mixed("y"), c["score"].alias("score"))

    if alpha >= 1:
        return cur
    return F.when(F.size(cur) == F.size(prev), F.zip_with(cur, prev, joint)).otherwise(cur)


# ------------------------------------------------------------------------------------------------------------ runs


def run_area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["x1"] - r["x0"])


def run_box(runs: Column) -> Column:
    """Tight box with exclusive ends; null for an empty mask."""
    edge = lambda f, n: f(F.transform(runs, lambda r: r[n]))
    return F.when(F.size(runs) > 0, box(edge(F.array_min, "x0"), edge(F.array_min, "y"), edge(F.array_max, "x1"), edge(F.array_max, "y") + 1))


def canvas(width: Column, height: Column, longest: int) -> Column:
    """Working size and scale: the longest side capped, never enlarged, sides rounded half to even, at least 1."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), F.bround(v * scale, 0).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"), scale.alias("scale"))
