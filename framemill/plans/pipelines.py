"""The two post-processing pipelines over instances, from filters to per-frame stats. One shuffle on the frame for suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PoseParams, SegmentationParams
from ..functions import geometry as G
from ..operators import instances as I


def _order(sort_by: str):
    return {"score": [F.desc("score"), F.col("idx")], "area": [F.desc(F.coalesce("area", F.lit(0.0))), F.col("idx")], "none": [F.col("idx")]}[sort_by]


def postprocess_boxes(df: DataFrame, frame: list[str], p: SegmentationParams) -> tuple[DataFrame, DataFrame]:
    """(instances, stats) of box-only segmentation: filters, suppression, merging, order, limit, clipped and rounded output.

    df has the frame columns, idx, score, label, box, image_width, image_height. There are no masks here: require_mask
    drops every row, rules on mask areas apply to none, and nms="mask" compares boxes, as it does wherever a mask is missing.
    """
    reason = I.drop_reason(F.col("score"), F.col("label"), p.confidence_threshold, p.allowed_labels, p.denied_labels)
    tagged = df.withColumn("drop_reason", F.coalesce(reason, F.lit("no_mask")) if p.require_mask else reason)
    stats = I.funnel(tagged, frame, ["confidence", "label", "no_mask"])
    live = tagged.where("drop_reason is null").withColumn("area", G.area(G.box_or_zero(F.col("box")))).withColumn("lab", F.col("label"))
    if p.nms != "none":
        sim = lambda a, b: G.iou(G.box_or_zero(a["box"]), G.box_or_zero(b["box"]))
        live = I.suppress(live, frame, sim, p.iou_threshold, ["label", "box", "area", "image_width", "image_height"], None if p.class_agnostic_nms else F.col("lab"))
    if p.merge_same_label:  # of each label the best-scored row stays
        live = I.merge_by_label(live, frame).drop("merged_from")
    kept = I.top_k(live, frame, _order(p.sort_by), p.max_detections)
    b = G.clip(F.col("box"), F.col("image_width"), F.col("image_height")) if p.clip_to_image else F.col("box")
    out = kept.withColumn("box", b)
    corners = {n: G.rounded(F.col("box")[n], 2) for n in ("x1", "y1", "x2", "y2")}
    return out.select(*frame, "id", F.col("idx").alias("source_index"), "label", G.rounded(F.col("score"), 6).alias("score"), *[c.alias(n) for n, c in corners.items()], G.rounded(G.area(F.col("box")), 2).alias("area")), stats


def postprocess_poses(df: DataFrame, frame: list[str], p: PoseParams) -> tuple[DataFrame, DataFrame]:
    """(instances, stats) of poses: filters, visibility, OKS or box suppression, order, limit, derived boxes and angles.

    df has the frame columns, idx, score, label, box (may be null), keypoints.
    """
    kps = G.hide_below(F.col("keypoints"), p.keypoint_threshold)
    seen = df.withColumn("keypoints", kps)
    n = F.coalesce(F.size(G.visible(F.col("keypoints"))), F.lit(0))
    first = [("no_keypoints", F.coalesce(F.size("keypoints"), F.lit(0)) <= 0)]
    tagged = seen.withColumn("drop_reason", I.drop_reason(F.col("score"), F.col("label"), p.confidence_threshold, p.allowed_labels, p.denied_labels, first))
    tagged = tagged.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (n < p.min_visible_keypoints), "keypoints").otherwise(F.col("drop_reason")))
    stats = I.funnel(tagged, frame, ["no_keypoints", "confidence", "label", "keypoints"])
    live = tagged.where("drop_reason is null").withColumn("area", G.pose_area(F.col("box"), F.col("keypoints"))).withColumn("lab", F.col("label"))
    if p.nms != "none":
        oks = lambda a, b: G.oks(a["keypoints"], b["keypoints"], a["area"], b["area"])
        hulls = lambda a, b: G.iou(G.box_or_zero(F.coalesce(a["box"], G.hull(a["keypoints"]))), G.box_or_zero(F.coalesce(b["box"], G.hull(b["keypoints"]))))
        live = I.suppress(live, frame, oks if p.nms == "oks" else hulls, p.oks_threshold if p.nms == "oks" else p.iou_threshold, ["label", "box", "area", "keypoints"], None if p.class_agnostic_nms else F.col("lab"))
    kept = I.top_k(live, frame, _order(p.sort_by), p.max_detections)
    derived = G.hull(F.col("keypoints"), p.bbox_padding)
    b = {"auto": F.coalesce(F.col("box"), derived), "keypoints": derived, "given": F.col("box"), "none": F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")}[p.bbox_mode]
    vis = G.visible(F.col("keypoints"))
    mean = F.when(F.size(vis) > 0, F.aggregate(vis, F.lit(0.0), lambda a, k: a + k["score"]) / F.size(vis)).otherwise(0.0)
    out = kept.withColumns({"box": b, "num_visible_keypoints": F.size(vis), "mean_keypoint_score": G.rounded(mean, 6)})
    return out.select(*frame, "id", F.col("idx").alias("source_index"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("person")).alias("label"), G.rounded(F.col("score"), 6).alias("score"), "num_visible_keypoints", "mean_keypoint_score", *[G.rounded(F.col("box")[c], 2).alias(c) for c in ("x1", "y1", "x2", "y2")], *([G.angles(F.col("keypoints")).alias("angles")] if p.compute_angles else [])), stats
