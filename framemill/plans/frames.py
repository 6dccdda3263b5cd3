"""Frames end to end: payloads with parameters of their own to instances, per-frame counts and JSON responses.

Every parameter is a field of the column p, so frames with different settings run in one job. A frame is never one
task's list: filters, masks and similar pairs are rows, and only the ordered walk of suppression carries a frame's numbers.
Masks are row-runs; decoding, cleaning and tracing are Arrow kernels a row, everything else is columns and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_INSTANCES, MAX_ITEMS, PoseParams, SegmentationParams, frame_params
from ..functions import geometry as G
from ..operators import encodings as E
from ..operators import instances as I
from ..operators import masks as M
from ..sources import payload as P
from ..tables import saved_wide as saved

FRAME = ["frame_key"]
NO_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def opt(name: str) -> Column:
    return F.col("p")[name]


def listed(b: Column, digits: int = 2) -> Column:
    return F.when(b.isNotNull(), F.array(*[G.rounded(b[c], digits) for c in ("x1", "y1", "x2", "y2")]))


def _first(*steps: tuple[Column, str]) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(steps[0][0], F.lit(False)), steps[0][1])
    for cond, name in steps[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def _label_steps() -> list[tuple[Column, str]]:
    text = F.lower(F.coalesce("label", F.lit("")))
    low = lambda name: F.transform(opt(name), lambda x: F.lower(x))
    denied = (text != "") & F.array_contains(low("denied_labels"), text)
    return [(~(F.col("score") >= opt("confidence_threshold")), "low_confidence"), ((F.size(opt("allowed_labels")) > 0) & ~F.array_contains(low("allowed_labels"), text), "by_label_filter"), (denied, "by_label_filter")]


def _group_label() -> Column:
    return F.coalesce(F.col("label"), F.concat(F.lit("#"), F.col("label_id").cast("string")))


def _ordered(df: DataFrame) -> DataFrame:
    """The first max_detections of a frame with their id, in the order asked for."""
    rank = F.when(opt("sort_by") == "score", -F.col("score")).when(opt("sort_by") == "area", -F.coalesce("area", F.lit(0.0))).otherwise(0.0)
    n = F.row_number().over(Window.partitionBy(*FRAME).orderBy(rank, "_place"))
    return df.withColumn("id", n - 1).where(F.col("id") < opt("max_detections"))


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of a frame's rows that may suppress each other: a before b by source_index, equal labels unless agnostic."""
    side = lambda n: df.select(*FRAME, F.struct("source_index", *columns, _group_label().alias("lab"), "agnostic").alias(n))
    same = F.col("a.agnostic") | F.col("a.lab").eqNullSafe(F.col("b.lab"))
    return side("a").join(side("b"), FRAME).where((F.col("a.source_index") < F.col("b.source_index")) & same)


def _suppressed(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return I.suppress_pairs(df, FRAME, pairs.select(*FRAME, F.col("a.source_index").alias("i"), F.col("b.source_index").alias("j")), index="source_index")


def _counts(heads: DataFrame, every: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """heads with the size of each stage of its frame: input, one column a drop reason, and those given."""
    reasons = every.groupBy(*FRAME).agg(F.count("*").alias("input_count"), *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in REASONS])
    out = heads.join(reasons, FRAME, "left")
    for name, df in stages:
        out = out.join(df.groupBy(*FRAME).agg(F.count("*").alias(name)), FRAME, "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("dropped_") or c == "input_count" or c in [n for n, _ in stages]])


REASONS = ["low_confidence", "by_label_filter", "no_mask", "by_area", "no_keypoints", "few_visible_keypoints"]


def segmentation(inst: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, frames): instances as they are answered, frames with canvas, counts and warnings.

    inst has frame_key, source_index, score, label, label_id, box, track_id, mask and extra (JSON), in pixels; heads has
    frame_key, image_width, image_height, p, warnings and whatever passes through.
    """
    heads = heads.withColumn("canvas", G.canvas(F.col("image_width"), F.col("image_height"), opt("mask_max_side")))
    scale = F.col("canvas.scale")
    rows = inst.drop("image_width", "image_height").join(heads.select(*FRAME, "image_width", "image_height", "p", "canvas"), FRAME)
    asked = rows.withColumn("reason", _first(*_label_steps()))
    live = E.with_decoded(asked.where("reason is null"), "mask", "d", F.col("canvas.w"), F.col("canvas.h"), F.col("image_width"), F.col("image_height"), opt("mask_binarize_threshold"))
    runs = F.when((opt("min_component_area") > 0) | opt("fill_holes"), M.cleaned()("d.runs", "canvas.w", "canvas.h", opt("min_component_area") * scale * scale, opt("fill_holes"))).otherwise(F.col("d.runs"))
    live = live.withColumn("runs", runs)
    pixels = G.run_area(F.col("runs")).cast("double")
    live = live.withColumn("area", F.when(F.col("runs").isNotNull(), pixels).when(F.col("box").isNotNull(), G.area(F.col("box"))))
    frame_area = F.col("canvas.w") * F.col("canvas.h")
    outside = F.col("runs").isNotNull() & ((pixels < opt("min_area") * scale * scale) | (pixels < opt("min_area_ratio") * frame_area) | (pixels > opt("max_area_ratio") * frame_area))
    live = live.withColumn("reason", _first((F.col("runs").isNull() & opt("require_mask"), "no_mask"), (outside, "by_area"))).drop("mask")
    live = saved(live, "masks")  # decoded once
    bad = live.where("d.failed or d.unknown").groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.when(F.col("d.failed"), F.col("source_index")))).alias("_failed"), F.count("*").alias("_unknown"))
    every = asked.where("reason is not null").select(*FRAME, "reason").union(live.select(*FRAME, "reason"))
    left = live.where("reason is null").drop("d", "reason")
    whole = F.min(F.col("runs").isNotNull()).over(Window.partitionBy(*FRAME))
    left = left.withColumns({"agnostic": opt("class_agnostic_nms"), "by_mask": (opt("nms") == "mask") & whole, "nms": opt("nms"), "limit": opt("iou_threshold"), "near_box": G.box_or_zero(F.coalesce("box", G.run_box(F.col("runs"))))})
    left = saved(left, "left")
    boxes = _pairs(left.where("not by_mask and nms <> 'none'"), ["near_box", "limit"]).where(G.iou(F.col("a.near_box"), F.col("b.near_box")) > F.col("a.limit"))
    shapes = M.overlap(left.where("by_mask"), FRAME, "source_index").withColumnRenamed("iou", "_iou")
    mate = lambda at, n: left.where("by_mask").select(*FRAME, F.col("source_index").alias(at), F.struct(_group_label().alias("lab"), "agnostic", "limit").alias(n))
    shapes = shapes.join(mate("i", "a"), [*FRAME, "i"]).join(mate("j", "b"), [*FRAME, "j"])  # overlaps alone, never a frame's pairs
    shapes = shapes.where((F.col("a.agnostic") | F.col("a.lab").eqNullSafe(F.col("b.lab"))) & (F.col("_iou").cast("float") > F.col("a.limit").cast("float")))
    pairs = boxes.select(*FRAME, "a", "b").select(*FRAME, F.col("a.source_index").alias("i"), F.col("b.source_index").alias("j")).union(shapes.select(*FRAME, "i", "j"))
    kept = saved(I.suppress_pairs(left, FRAME, pairs, index="source_index"), "kept")
    merged = _merged(kept)
    out = _ordered(merged)
    b = F.when(F.col("runs").isNotNull() & (opt("bbox_from_mask") | F.col("box").isNull()), _times(G.run_box(F.col("runs")), 1 / scale)).otherwise(F.col("box"))
    out = out.withColumn("box", b).withColumn("box", F.when(F.col("box").isNotNull() & opt("clip_to_image"), G.clip(F.col("box"), F.col("image_width"), F.col("image_height"))).otherwise(F.col("box")))
    area = F.when(F.col("runs").isNotNull(), G.run_area(F.col("runs")) / scale / scale).when(F.col("box").isNotNull(), G.area(F.col("box")))
    form = opt("output_mask")
    polygons = F.when(F.col("runs").isNotNull() & form.isin("polygon", "both"), M.traced()("runs", "canvas.w", "canvas.h", opt("simplify_tolerance"), scale))
    counts = F.when(F.col("runs").isNotNull() & form.isin("rle", "both"), M.encode_counts()(F.col("runs"), F.col("canvas.w"), F.col("canvas.h")))
    size = F.array(F.col("canvas.h"), F.col("canvas.w"))
    mask = F.struct(size.alias("size"), G.rounded(scale, 6).alias("scale"), F.when(form == "both", "polygon+rle").otherwise(form).alias("format"), polygons.alias("polygons"), F.when(form.isin("polygon", "both"), "image_pixels").alias("coordinate_space"), F.when(form.isin("rle", "both"), F.struct(size.alias("size"), counts.alias("counts"), F.lit("F").alias("order"))).alias("rle"), F.when(form.isin("rle", "both"), F.format_string("uncompressed COCO RLE, column-major, at 'size' resolution (image is %dx%d)", F.col("image_width"), F.col("image_height"))).alias("rle_note"))
    extra = F.when(opt("keep_extra_fields"), F.col("extra"))
    out = out.select(*FRAME, "id", "source_index", "label", "label_id", G.rounded(F.col("score"), 6).alias("score"), listed(F.col("box")).alias("bbox"), F.lit("xyxy").alias("bbox_format"), F.transform(G.to_xywh(F.col("box")), lambda x: G.rounded(x, 2)).alias("bbox_xywh"), G.rounded(area, 2).alias("area"), F.col("runs").isNotNull().alias("has_mask"), F.col("track").alias("track_id"), F.when(F.col("runs").isNotNull() & (form != "none"), mask).alias("mask"), extra.alias("extra"), F.when(F.col("merged_from") > 1, F.col("merged_from")).alias("merged_from"))
    out = saved(out, "instances")
    how = left.groupBy(*FRAME).agg(F.first("by_mask").alias("_mask"))
    frames = _counts(heads, every, [("_left", left), ("_kept", kept), ("_merged", merged), ("kept", out)]).join(bad, FRAME, "left").join(how, FRAME, "left")
    used = F.when(opt("nms") == "none", "none").when((opt("nms") == "mask") & F.coalesce("_mask", F.lit(True)), "mask_iou").otherwise("box_iou")
    c = F.col("canvas")
    shrunk = F.when(c["scale"] < 1, F.format_string("masks rasterised at %dx%d (scale %.3f)", c["w"], c["h"], c["scale"]))
    failed = F.transform(F.coalesce("_failed", F.array().cast("array<int>")), lambda i: F.concat(F.lit("instance "), i.cast("string"), F.lit(": mask decode failed")))
    unknown = F.when(F.col("_unknown") > 0, F.format_string("%d instance(s) had a mask field that could not be decoded", F.col("_unknown")))
    warnings = F.concat("warnings", F.array_compact(F.array(shrunk)), failed, F.array_compact(F.array(unknown)))
    frames = frames.withColumns({"suppressed_by_nms": F.col("_left") - F.col("_kept"), "merged": F.col("_kept") - F.col("_merged"), "nms_similarity": used, "warnings": warnings})
    return out, frames.drop("_left", "_kept", "_merged", "_failed", "_unknown", "_mask", "dropped_no_keypoints", "dropped_few_visible_keypoints")


def _times(b: Column, f: Column) -> Column:
    return F.when(b.isNotNull(), G.box(*[b[c] * f for c in ("x1", "y1", "x2", "y2")]))


def _merged(kept: DataFrame) -> DataFrame:
    """Frames that ask for it have one row a label: the best row with the union of all masks, its box then from the mask."""
    kept = kept.withColumns({"_place": F.col("source_index"), "merged_from": F.lit(1).cast("long")})
    rows = kept.where(opt("merge_same_label")).withColumn("_label", F.coalesce(F.col("label"), F.col("label_id").cast("string"), F.lit("None")))
    others = [c for c in kept.columns if c not in (*FRAME, "runs", "_place", "merged_from")]
    best = F.max_by(F.struct(*others), F.struct("score", -F.col("source_index"))).alias("_best")
    groups = rows.groupBy(*FRAME, "_label").agg(best, F.count("*").alias("merged_from"), F.min("source_index").alias("_place"), F.flatten(F.collect_list("runs")).alias("_runs"))
    groups = groups.select(*FRAME, "_best.*", "merged_from", "_place", F.when(F.size("_runs") > 0, I.unite(F.col("_runs"))).alias("runs"))
    many = (F.col("merged_from") > 1) & F.col("runs").isNotNull()
    groups = groups.withColumns({"area": F.when(many, G.run_area(F.col("runs")).cast("double")).otherwise(F.col("area")), "box": F.when(~F.coalesce(many, F.lit(False)), F.col("box"))})
    return kept.where(~opt("merge_same_label")).unionByName(groups)


def layout_of(spec: Column, observed: Column) -> Column:
    """name, names, sigmas, skeleton and angles of a keypoint layout: a known name, a JSON object, or made for the count."""
    v = F.try_parse_json(spec)
    get = lambda n, kind: F.try_variant_get(v, f"$.{n}", kind)
    count = F.greatest(F.coalesce(F.nullif(F.size(get("names", "array<string>")), F.lit(-1)), F.lit(0)), F.lit(0))
    count = F.when(count > 0, count).otherwise(F.coalesce(get("num_keypoints", "int"), observed, F.lit(0)))
    numbered = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("kp_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    flat = lambda n: F.array_repeat(F.lit(G.DEFAULT_SIGMA), n)
    edges, triples = "array<array<int>>", "map<string,array<int>>"
    make = lambda name, names, sigmas, skeleton, angles: F.struct(name.alias("name"), names.alias("names"), sigmas.alias("sigmas"), skeleton.cast(edges).alias("skeleton"), angles.cast(triples).alias("angles"))
    names = F.when(F.size(get("names", "array<string>")) > 0, get("names", "array<string>")).otherwise(numbered(count))
    sigmas = F.slice(F.concat(F.coalesce(get("sigmas", "array<double>"), F.array().cast("array<double>")), flat(count)), F.lit(1), count)
    no_angles = F.create_map().cast(triples)
    own = make(F.coalesce(get("name", "string"), F.lit("custom")), names, sigmas, F.coalesce(get("skeleton", edges), F.array().cast(edges)), F.coalesce(get("angles", triples), no_angles))
    coco = make(F.lit("coco17"), F.lit(G.COCO17_NAMES), F.lit(G.COCO17_SIGMAS), F.lit([list(e) for e in G.COCO17_SKELETON]), F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(list(t))) for n, t in G.COCO17_ANGLES])))
    k = F.coalesce(observed, F.lit(17))
    made = make(F.concat(F.lit("generic"), k.cast("string")), numbered(k), flat(k), F.array().cast(edges), no_angles)
    return F.when(spec.startswith("{"), own).when((F.lower(spec) == "coco17") | (k == 17), coco).otherwise(made)


def previous_instances(heads: DataFrame) -> DataFrame:
    """frame_key, p_idx, p_track_id, p_keypoints from the previous response (or its instances, or bare keypoints) that came with a frame."""
    rows = heads.where("p.smoothing").select(*FRAME, F.posexplode_outer(P.previous_of(F.col("previous"))).alias("p_idx", "v"))
    return rows.select(*FRAME, "p_idx", F.col("v.track").alias("p_track_id"), F.col("v.points").alias("p_keypoints")).where("p_keypoints is not null")


def _smoothed(live: DataFrame, prev: DataFrame) -> DataFrame:
    """live with keypoints blended with their match in the previous frame: by track id, else the most similar one."""
    by_track = prev.where("p_track_id is not null").groupBy(*FRAME, F.col("p_track_id").alias("track_id")).agg(F.max_by("p_keypoints", "p_idx").alias("_tracked"), F.min("p_idx").alias("_first"))
    # tracked instances are tried before the others, a track at its first place with its last keypoints
    tries = by_track.select(*FRAME, F.struct(F.lit(0).alias("k"), F.col("_first").alias("i")).alias("_rank"), F.col("_tracked").alias("p_keypoints"))
    tries = tries.union(prev.where("p_track_id is null").select(*FRAME, F.struct(F.lit(1).alias("k"), F.col("p_idx").alias("i")).alias("_rank"), "p_keypoints"))
    live = live.join(by_track.drop("_first"), [*FRAME, "track_id"], "left")
    open_ = live.where("_tracked is null").select(*FRAME, "source_index", "keypoints", "area", "sigmas", "p")
    near = open_.join(tries, FRAME).where(F.size("keypoints") == F.size("p_keypoints")).withColumn("_near", G.oks(F.col("keypoints"), F.col("p_keypoints"), F.col("area"), F.col("area"), F.col("sigmas")))
    near = near.where((F.col("_near") > 0) & (F.col("_near") >= opt("match_threshold")))
    best = near.groupBy(*FRAME, "source_index").agg(F.max_by("p_keypoints", F.struct("_near", -F.col("_rank.k"), -F.col("_rank.i"))).alias("_best"))
    live = live.join(best, [*FRAME, "source_index"], "left").withColumn("_match", F.coalesce("_tracked", "_best"))

    def joint(c, p):
        far = F.sqrt((c["x"] - p["x"]) * (c["x"] - p["x"]) + (c["y"] - p["y"]) * (c["y"] - p["y"]))
        on = (c["score"] > 0) & (p["score"] > 0) & F.coalesce(far <= opt("max_jump"), F.lit(True))
        blend = lambda n: F.when(on, opt("alpha") * c[n] + (1 - opt("alpha")) * p[n]).otherwise(c[n]).alias(n)
        return F.struct(blend("x"), blend("y"), c["score"].alias("score"))

    fits = (F.size("keypoints") == F.size("_match")) & (opt("alpha") < 1)
    return live.withColumns({"keypoints": F.when(fits, F.zip_with("keypoints", "_match", joint)).otherwise(F.col("keypoints")), "smoothed": F.col("_match").isNotNull()}).drop("_tracked", "_best", "_match")


def pose(inst: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, frames) of poses, like segmentation(); inst has keypoints instead of mask, heads has previous (VARIANT, may be null)."""
    observed = inst.groupBy(*FRAME).agg(F.max(F.size("keypoints")).alias("_k"))
    heads = heads.join(observed, FRAME, "left").withColumn("_k", F.when(F.col("_k") > 0, F.col("_k"))).withColumn("layout", layout_of(opt("layout"), F.col("_k")))
    heads = saved(heads, "heads")
    rows = inst.drop("image_width", "image_height").join(heads.select(*FRAME, "image_width", "image_height", "p", F.col("layout.sigmas").alias("sigmas"), F.col("layout.names").alias("names"), F.col("layout.angles").alias("triples")), FRAME)
    hidden = F.transform("keypoints", lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.when(k["score"] < opt("keypoint_threshold"), 0.0).otherwise(k["score"]).alias("score")))
    rows = rows.withColumn("keypoints", hidden)
    few = F.size(G.visible(F.col("keypoints"))) < opt("min_visible_keypoints")
    every = rows.withColumn("reason", _first((F.coalesce(F.size("keypoints"), F.lit(0)) <= 0, "no_keypoints"), *_label_steps(), (few, "few_visible_keypoints")))
    every = saved(every, "poses")
    left = every.where("reason is null").drop("reason").withColumn("area", G.pose_area(F.col("box"), F.col("keypoints")))
    prev = previous_instances(heads)
    ask = _smoothed(left.where("p.smoothing"), prev)
    left = left.where("not p.smoothing").withColumn("smoothed", F.lit(False)).unionByName(ask)
    left = left.withColumns({"agnostic": opt("class_agnostic_nms"), "near_box": G.box_or_zero(F.coalesce("box", G.hull(F.col("keypoints")))), "nms": opt("nms"), "limit": F.when(opt("nms") == "oks", opt("oks_threshold")).otherwise(opt("iou_threshold"))})
    left = saved(left, "left")
    pairs = _pairs(left.where("nms <> 'none'"), ["keypoints", "area", "sigmas", "near_box", "nms", "limit"])
    a, b = F.col("a"), F.col("b")
    near = F.when(a["nms"] == "oks", G.oks(a["keypoints"], b["keypoints"], a["area"], b["area"], a["sigmas"])).otherwise(G.iou(a["near_box"], b["near_box"]))
    kept = saved(_suppressed(left, pairs.where(near > a["limit"])), "kept")
    out = _ordered(kept.withColumn("_place", F.col("source_index")))
    side = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.col(top).cast("double"))
    clipped = F.transform("keypoints", lambda k: F.struct(side(k["x"], "image_width").alias("x"), side(k["y"], "image_height").alias("y"), k["score"].alias("score")))
    out = out.withColumn("keypoints", F.when(opt("clip_to_image"), clipped).otherwise(F.col("keypoints")))
    tight = G.hull(F.col("keypoints"))
    px, py = (tight["x2"] - tight["x1"]) * opt("bbox_padding"), (tight["y2"] - tight["y1"]) * opt("bbox_padding")
    derived = F.when(tight.isNotNull(), G.box(tight["x1"] - px, tight["y1"] - py, tight["x2"] + px, tight["y2"] + py))
    mode = opt("bbox_mode")
    box = F.when(mode == "given", F.col("box")).when(mode == "keypoints", derived).when(mode == "auto", F.coalesce("box", derived))
    out = out.withColumn("box", box).withColumn("box", F.when(F.col("box").isNotNull() & opt("clip_to_image"), G.clip(F.col("box"), F.col("image_width"), F.col("image_height"))).otherwise(F.col("box")))
    k, seen = F.col("keypoints"), G.visible(F.col("keypoints"))
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x["score"]) / F.size(seen)).otherwise(0.0)
    points = F.transform(k, lambda x, i: F.struct(i.alias("index"), F.coalesce(F.get(F.col("names"), i), F.concat(F.lit("kp_"), i.cast("string"))).alias("name"), G.rounded(x["x"], 2).alias("x"), G.rounded(x["y"], 2).alias("y"), G.rounded(x["score"], 6).alias("score"), (x["score"] > 0).alias("visible")))
    points = F.when(opt("drop_invisible_keypoints"), F.filter(points, lambda x: x["visible"])).otherwise(points)
    angles = F.map_filter(F.transform_values("triples", lambda _, t: G.rounded(G.angle(k, t[0], t[1], t[2]), 2)), lambda _, v: v.isNotNull())
    out = out.select(*FRAME, "id", "source_index", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("person")).alias("label"), "label_id", G.rounded(F.col("score"), 6).alias("score"), listed(F.col("box")).alias("bbox"), F.lit("xyxy").alias("bbox_format"), F.transform(G.to_xywh(F.col("box")), lambda x: G.rounded(x, 2)).alias("bbox_xywh"), F.size(k).alias("num_keypoints"), F.size(seen).alias("num_visible_keypoints"), G.rounded(mean, 6).alias("mean_keypoint_score"), points.alias("keypoints"), F.flatten(F.transform(k, lambda x: F.array(*[G.rounded(x[c], 2) for c in ("x", "y", "score")]))).alias("keypoints_flat"), F.col("track").alias("track_id"), F.when(opt("compute_angles"), angles).alias("angles"), F.when(opt("keep_extra_fields"), F.col("extra")).alias("extra"))
    out = saved(out, "instances")
    frames = _counts(heads, every, [("_left", left), ("_kept", kept), ("kept", out), ("smoothed", left.where("smoothed"))])
    has_prev = prev.select(*FRAME).distinct().withColumn("_prev", F.lit(True))
    frames = frames.join(has_prev, FRAME, "left")
    names = F.size("layout.names")
    odd = F.when((F.col("_k") > 0) & (F.col("_k") != names), F.format_string("model emitted %d keypoints but layout '%s' defines %d", F.col("_k"), F.col("layout.name"), names))
    alone = F.when(opt("smoothing") & F.col("_prev").isNull(), "smoothing is enabled but no usable 'previous' frame was supplied; skipped")
    how = F.when((opt("nms") == "none") | (F.col("_left") < 2), opt("nms")).otherwise(F.when(opt("nms") == "oks", "oks").otherwise("box_iou"))
    frames = frames.withColumns({"suppressed_by_nms": F.col("_left") - F.col("_kept"), "nms_similarity": how, "warnings": F.concat("warnings", F.array_compact(F.array(odd, alone)))})
    frames = frames.withColumn("layout", F.struct("layout.name", "layout.names", names.alias("num_keypoints"), F.when(opt("include_skeleton"), F.col("layout.skeleton")).alias("skeleton")))
    return out, frames.drop("_left", "_kept", "_k", "_prev", "dropped_no_mask", "dropped_by_area")


# ---------------------------------------------------------------------------------------------- routing and responses

#: What a frame's counts are called in its stats, by task.
STATS = {"segmentation": ["input_count", "dropped_low_confidence", "dropped_by_label_filter", "dropped_no_mask", "dropped_by_area", "suppressed_by_nms", "merged", "kept", "nms_similarity"], "pose": ["input_count", "dropped_low_confidence", "dropped_by_label_filter", "dropped_no_keypoints", "dropped_few_visible_keypoints", "suppressed_by_nms", "smoothed", "kept", "nms_similarity"]}


def responses(out: DataFrame, frames: DataFrame, task: str) -> DataFrame:
    """frame_key, status_code, n_instances and the response as JSON, at whose end stand the payload's own fields that pass through."""
    value = lambda c: F.try_parse_json(c).alias(c)
    columns = [value(c) if c in ("extra", "track_id") else F.col(c) for c in out.columns if c not in FRAME]
    lists = out.withColumn("_i", F.struct("id", F.to_json(F.struct(*columns)).alias("j"))).groupBy(*FRAME).agg(F.array_sort(F.collect_list("_i")).alias("_list"))
    rows = frames.join(lists, FRAME, "left").withColumn("_list", F.coalesce("_list", F.array().cast("array<struct<id:int,j:string>>")))
    stats = F.to_json(F.struct(F.col("container").alias("source_container"), *STATS[task]))
    head = F.to_json(F.struct(F.lit(task).alias("task"), "model_id", value("frame_id"), F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height")).alias("image"), *([F.struct(F.col("canvas.w").alias("width"), F.col("canvas.h").alias("height"), "canvas.scale").alias("mask_canvas")] if task == "segmentation" else [F.col("layout").alias("keypoint_layout")]), F.size("_list").alias("count"), "warnings", F.col("p").dropFields("wrong").alias("params")))
    items = F.concat(F.lit("["), F.array_join(F.transform("_list", lambda x: x["j"]), ","), F.lit("]"))
    inside = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    # frame_id is among the head's fields
    passed = F.to_json(F.map_filter(P.as_map(F.try_parse_json("passed")), lambda k, v: k != "frame_id"))
    rows = rows.withColumns({"_head": head, "_stats": stats, "_items": items, "_passed": F.coalesce(passed, F.lit("{}"))})
    last = F.when(F.col("_passed") == "{}", "").otherwise(F.concat(F.lit(","), inside("_passed")))
    text = F.concat(F.lit("{"), inside("_head"), F.lit(',"stats":'), "_stats", F.lit(',"instances":'), "_items", F.lit(',"detections":'), "_items", last, F.lit("}"))
    return rows.select(*FRAME, F.lit(200).alias("status_code"), F.size("_list").alias("n_instances"), text.alias("response"), F.lit(None).cast("string").alias("error"))


TASKS = {"segmentation": (SegmentationParams, segmentation), "pose": (PoseParams, pose)}


def run(frames: DataFrame, task: str | None = None, model_id: str | None = None, params: str | None = None, **defaults) -> DataFrame:
    """A response (or an error with its status) a frame: frames has frame_key and payload (JSON).

    task, model_id: what the batch says, ahead of what a frame says. params: JSON of shared parameters, behind a frame's own.
    Columns batch_task, batch_model and batch_params of frames say the same a frame. defaults: parameters of the job. A bad
    frame never fails the others.
    """
    says = lambda name, c: F.coalesce(F.lit(name).cast("string"), *[F.col(x) for x in (c,) if x in frames.columns])
    heads = P.read_frames(frames, max_instances=MAX_INSTANCES).drop("payload")
    route = P.route(F.coalesce(says(task, "batch_task"), F.col("declared_task")), F.col("hint"), F.coalesce(says(model_id, "batch_model"), F.col("asked_model")))
    heads = saved(heads.withColumns({"task": route, "params": P.merged_params(says(params, "batch_params"), F.col("params"))}), "frames")
    lost = (F.col("status_code") != 200) | F.col("task").isNull()
    error = F.coalesce("error", F.lit("could not determine the task"))
    bad = [heads.where(lost).select(*FRAME, F.when(F.col("status_code") == 200, 400).otherwise(F.col("status_code")).alias("status_code"), error.alias("error"))]
    done = []
    for name in [r.task for r in heads.where(~lost).select("task").distinct().collect()]:  # two at most
        kind, plan = TASKS[name]
        base = kind(**{k: v for k, v in defaults.items() if k in kind.__dataclass_fields__})
        own = saved(frame_params("params", base, heads.where(~lost & (F.col("task") == name))), "own")
        bad.append(own.where(F.size("p.wrong") > 0).select(*FRAME, F.lit(422).alias("status_code"), F.concat(F.lit("invalid parameters: "), F.to_json("p.wrong")).alias("error")))
        own = own.where(F.size("p.wrong") == 0)
        inst = saved(P.read_instances(own, bbox_format=F.col("p.bbox_format")), "read")
        odd = inst.where("bad").groupBy(*FRAME).agg(F.min("source_index").alias("_at"))
        bad.append(odd.select(*FRAME, F.lit(500).alias("status_code"), F.concat(F.lit("instance "), F.col("_at").cast("string"), F.lit(": a coordinate is no number")).alias("error")))
        inst, own = inst.drop("bad").join(odd, FRAME, "left_anti"), own.join(odd, FRAME, "left_anti")
        inst, own = I.place(inst, own.select(*FRAME, "image_width", "image_height", "p", "previous", "container", "model_id", "frame_id", "passed"), FRAME, opt("coordinate_space"), opt("bbox_format"))
        done.append(responses(*plan(saved(inst, "placed"), saved(own, "headers")), name))
    failed = reduce(DataFrame.union, bad).select(*FRAME, "status_code", F.lit(0).alias("n_instances"), F.lit(None).cast("string").alias("response"), "error")
    return reduce(DataFrame.unionByName, [*done, failed])


def run_batches(batches: DataFrame, batch: str = "batch_key", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(a row an item, a row a batch with count, failed, status_code) of batch envelopes: lists, or objects with items, frames or batch.

    An envelope's task and model go before its items', its params behind theirs; over MAX_ITEMS items are refused.
    """
    found = P.read_envelopes(batches, body).select(batch, "items", F.col("task").alias("batch_task"), F.col("model").alias("batch_model"), F.col("shared").alias("batch_params"))
    refused = F.when(F.col("items").isNull(), 400).when(F.size("items") > MAX_ITEMS, 413).otherwise(200)
    found = saved(found.withColumn("status_code", refused), "batches")
    said = ["batch_task", "batch_model", "batch_params"]
    rows = found.where("status_code = 200").select(batch, *said, F.posexplode("items").alias("index", "payload"))
    key = F.concat_ws("/", F.col(batch).cast("string"), F.col("index").cast("string"))
    rows = rows.withColumn("frame_key", key)
    items = rows.select("frame_key", batch, "index").join(run(rows.select("frame_key", "payload", *said)), "frame_key").drop("frame_key")
    counts = items.groupBy(batch).agg(F.count("*").alias("count"), F.count_if(F.col("status_code") != 200).alias("failed"))
    return items, found.select(batch, "status_code").join(counts, batch, "left").fillna(0, ["count", "failed"])
