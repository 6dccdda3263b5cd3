"""Operators over instances: one row per candidate, frame key columns first. All are shuffles on the frame at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_reason(score: Column, label: Column, threshold: float, allowed=None, denied=None, first: list[tuple[str, Column]] = ()) -> Column:
    """The first filter of the waterfall that drops a row, or null. Labels compare in lower case; an empty list allows all."""
    text = F.lower(F.coalesce(label, F.lit("")))
    steps = [*first, ("confidence", ~(score >= threshold))]
    if allowed:
        steps.append(("label", ~text.isin([x.lower() for x in allowed])))
    if denied:
        steps.append(("label", text.isin([x.lower() for x in denied]) & (text != "")))
    out = F.when(steps[0][1], steps[0][0])
    for name, cond in steps[1:]:
        out = out.when(cond, name)
    return out


def funnel(df: DataFrame, frame: list[str], reasons: list[str]) -> DataFrame:
    """Counters per frame from drop_reason: input, one per reason, kept."""
    counts = [F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in reasons]
    return df.groupBy(*frame).agg(F.count("*").alias("input_count"), *counts, F.count_if(F.col("drop_reason").isNull()).alias("kept"))


def suppress(df: DataFrame, frame: list[str], similarity: Callable[[Column, Column], Column], threshold: float, payload: list[str], label: Column | None = None, score: str = "score", index: str = "idx") -> DataFrame:
    """Greedy suppression: by score (ties by index), a row stays unless a kept row of its label is more similar than the threshold.

    One shuffle on the frame (and label); the ordered walk is a fold over the frame's sorted array.
    """
    lab = F.lit(None).cast("string") if label is None else label.cast("string")
    item = F.struct((-F.col(score)).alias("_s"), F.col(index).alias("_i"), lab.alias("_l"), *[F.col(c) for c in payload])
    rows = df.groupBy(*frame).agg(F.array_sort(F.collect_list(item)).alias("_all"))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: k["_l"].eqNullSafe(x["_l"]) & (similarity(k, x) > threshold))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("_all", F.slice("_all", 1, 0), step)
    out = rows.select(*frame, F.explode(kept).alias("k"))
    return out.select(*frame, F.col("k._i").alias(index), (-F.col("k._s")).alias(score), *[F.col(f"k.{c}") for c in payload])


def suppress_pairs(df: DataFrame, frame: list[str], pairs: DataFrame, score: str = "score", index: str = "idx") -> DataFrame:
    """Greedy suppression where the similar pairs of a frame are known: pairs has i and j, df stays as it is but for the rows that go.

    By score (ties by index), a row stays unless it is similar to a kept row. A frame's ordered walk carries numbers only.
    """
    both = pairs.select(*frame, F.col("i").alias(index), F.col("j").alias("_o")).union(pairs.select(*frame, F.col("j"), F.col("i")))
    near = both.groupBy(*frame, index).agg(F.collect_list("_o").alias("_near"))
    item = F.struct((-F.col(score)).alias("s"), F.col(index).alias("i"), F.col("_near").alias("n"))
    # only rows with a neighbour can go; the others never enter the walk
    walk = df.select(*frame, index, score).join(near, [*frame, index]).groupBy(*frame).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    start = F.transform(F.slice("_all", 1, 0), lambda x: x["i"])
    kept = F.aggregate("_all", start, lambda acc, x: F.when(F.arrays_overlap(acc, x["n"]), acc).otherwise(F.concat(acc, F.array(x["i"]))))
    gone = walk.select(*frame, F.explode(F.array_except(F.transform("_all", lambda x: x["i"]), kept)).alias(index))
    return df.join(gone, [*frame, index], "left_anti")


def top_k(df: DataFrame, frame: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of a frame with their 0-based id; Spark limits groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*frame).orderBy(*order))
    return df.withColumn("id", n - 1).where(F.col("id") < k)


def pairs_within(df: DataFrame, frame: list[str], index: str = "idx") -> DataFrame:
    """Pairs (a, b) of a frame's rows as structs, a before b."""
    s = df.select(*frame, F.struct(*df.columns).alias("a"))
    t = df.select(*frame, F.struct(*df.columns).alias("b"))
    return s.join(t, frame).where(F.col(f"a.{index}") < F.col(f"b.{index}"))


def merge_by_label(df: DataFrame, frame: list[str], label: str = "label", score: str = "score", index: str = "idx", runs: str | None = None) -> DataFrame:
    """One row per frame and label: the best-scored row leads, masks are united, merged_from counts the rows."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in (*frame, label)]), F.struct(F.col(score), -F.col(index)))
    aggs = [best.alias("_best"), F.count("*").alias("merged_from"), F.min(index).alias("_first")]
    if runs:
        aggs.append(F.flatten(F.collect_list(runs)).alias("_runs"))
    out = df.groupBy(*frame, label).agg(*aggs).select(*frame, label, "_best.*", "merged_from", *(["_runs"] if runs else []))
    return out.withColumn(runs, unite(F.col("_runs"))).drop("_runs") if runs else out


def unite(runs: Column) -> Column:
    """Sorted disjoint row-runs from any runs."""

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["y"] == r["y"]) & (F.try_element_at(acc, F.lit(-1))["x1"] >= r["x0"])
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["y"].alias("y"), last["x0"].alias("x0"), F.greatest(last["x1"], r["x1"]).alias("x1"))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    s = F.array_sort(runs)
    return F.aggregate(s, F.slice(s, 1, 0), step)


def scale_normalised(df: DataFrame, frame: list[str], limit: float = 1.5) -> DataFrame:
    """Boxes of frames whose coordinates all lie within the limit are multiplied by the known image size.

    df has box, image_width, image_height. Adds scaled (whether it was) and needs_size (it should have been, size unknown).
    """
    b = F.col("box")
    most = F.greatest(*[F.abs(b[n]) for n in ("x1", "y1", "x2", "y2")])
    small = F.max(most).over(Window.partitionBy(*frame)) <= limit
    known = F.col("image_width").isNotNull() & F.col("image_height").isNotNull()
    scaled = F.struct(*[(b[n] * F.col(f"image_{s}")).alias(n) for n, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))])
    return df.withColumns({"_small": small}).withColumns({"scaled": F.coalesce(F.col("_small") & known, F.lit(False)), "needs_size": F.coalesce(F.col("_small") & ~known, F.lit(False))}).withColumn("box", F.when(F.col("scaled"), scaled).otherwise(b)).drop("_small")


def infer_size(df: DataFrame, frame: list[str], default: tuple[int, int] = (1920, 1080)) -> DataFrame:
    """image_width and image_height from the farthest coordinates where unknown; the default for frames without boxes."""
    w = Window.partitionBy(*frame)
    far = lambda n: F.ceil(F.max(F.col("box")[n]).over(w)).cast("int") + 1
    pick = lambda known, n, d: F.coalesce(F.col(known), far(n), F.lit(d))
    return df.withColumns({"size_known": F.col("image_width").isNotNull(), "image_width": pick("image_width", "x2", default[0]), "image_height": pick("image_height", "y2", default[1])})


def place(df: DataFrame, heads: DataFrame, frame: list[str], mode: Column, fmt: Column, default: tuple[int, int] = (1920, 1080), limit: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Instances in pixels, and heads with their final image size and warnings: coordinates in 0..1 are scaled, unknown sizes inferred.

    df has box (may be null), box_format and keypoints (may be null); heads has image_width and image_height (null: unknown).
    mode (auto, pixel, normalized) and fmt (the box format asked for) are columns of heads. One aggregation a frame.
    """
    b, k = F.col("box"), F.col("keypoints")
    every = F.flatten(F.array(F.when(b.isNotNull(), F.array(b["x1"], b["y1"], b["x2"], b["y2"])).otherwise(F.array().cast("array<double>")), F.coalesce(F.flatten(F.transform(k, lambda p: F.array(p["x"], p["y"]))), F.array().cast("array<double>"))))
    finite = F.filter(every, lambda x: ~F.isnan(x))
    xs = F.array_max(F.concat(F.array(b["x2"]), F.coalesce(F.transform(k, lambda p: p["x"]), F.array().cast("array<double>"))))
    ys = F.array_max(F.concat(F.array(b["y2"]), F.coalesce(F.transform(k, lambda p: p["y"]), F.array().cast("array<double>"))))
    seen = df.groupBy(*frame).agg(F.max(F.array_max(F.transform(finite, lambda x: F.abs(x)))).alias("_far"), F.max(xs).alias("_x"), F.max(ys).alias("_y"), F.count("*").alias("_n"), F.count_distinct("box_format").alias("_kinds"))
    known = F.col("image_width").isNotNull() & F.col("image_height").isNotNull()
    small = (mode == "auto") & F.coalesce(F.col("_far") <= limit, F.lit(False))
    rows = heads.join(seen, frame, "left").withColumns({"_known": known, "_w": F.when(known, F.col("image_width")).otherwise(default[0]), "_h": F.when(known, F.col("image_height")).otherwise(default[1])})
    rows = rows.withColumn("_scale", (mode == "normalized") | (small & F.col("_known")))
    by = lambda n, side: F.greatest(F.col(n), F.lit(0.0)) * F.when(F.col("_scale"), F.col(side)).otherwise(1)
    infer = ~F.col("_known") & (F.coalesce("_n", F.lit(0)) > 0)
    rows = rows.withColumns({"_x": by("_x", "_w"), "_y": by("_y", "_h")}).withColumn("_infer", infer & (F.col("_x") > 0) & (F.col("_y") > 0))
    size = lambda n, side: F.when(F.coalesce("_infer", F.lit(False)), F.ceil(n).cast("int") + 1).otherwise(F.col(side))
    rows = rows.withColumns({"image_width": size("_x", "_w"), "image_height": size("_y", "_h")})
    says = lambda cond, *text: F.when(cond, F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]))
    dims = F.concat_ws("x", F.col("image_width").cast("string"), F.col("image_height").cast("string"))
    warnings = F.array_compact(F.array(
        says((fmt == "auto") & (F.col("_kinds") > 1), "mixed bbox formats inferred across instances; set params.bbox_format explicitly ('xyxy', 'xywh' or 'cxcywh') if boxes look wrong"),
        says(small & ~F.col("_known"), "coordinates look normalised (0..1) but no image size was supplied; leaving them as-is. Send image.width / image.height to rescale."),
        says(small & F.col("_known"), "coordinates detected as normalised (0..1) and scaled to pixels"),
        says(infer & F.coalesce("_infer", F.lit(False)), "image size not supplied; inferred ", dims, " from prediction extents. Send image.width / image.height for exact mask rasterisation."),
        says(infer & ~F.coalesce("_infer", F.lit(False)), "image size not supplied; assuming ", dims),
    ))
    rows = rows.withColumn("warnings", warnings)
    to = rows.select(*frame, F.when(F.col("_scale"), F.col("_w")).otherwise(1).alias("_w"), F.when(F.col("_scale"), F.col("_h")).otherwise(1).alias("_h"))
    moved = F.struct(*[(b[c] * F.col(f"_{s}")).alias(c) for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))])
    kps = F.transform(k, lambda p: F.struct((p["x"] * F.col("_w")).alias("x"), (p["y"] * F.col("_h")).alias("y"), p["score"].alias("score")))
    placed = df.join(to, frame).withColumns({"box": F.when(b.isNotNull(), moved), "keypoints": kps}).drop("_w", "_h")
    return placed, rows.drop("_far", "_x", "_y", "_n", "_kinds", "_known", "_w", "_h", "_scale", "_infer")
