"""Registered queries over frames derived from the star tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import PoseParams, SegmentationParams, params_table
from .functions import geometry as G
from .operators import encodings as E
from .operators import instances as I
from .operators import masks as M
from .operators import regions as V
from .operators import runs as N
from .plans import frames as R
from .plans import pipelines
from .sources import payload as P
from .sources import sink
from .streaming import chain as K
from .streaming import smoothing as S
from .tables import shared_folder, spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------------------- derived views

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def det_boxes(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    x1, y1 = (F.col("l_partkey") % 7 * 10).cast("double"), (F.col("l_suppkey") % 5 * 10).cast("double")
    idx = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1).cast("int")
    return li.select(F.col("l_orderkey").alias("frame"), idx.alias("idx"), (F.col("l_quantity") / 50).alias("score"), F.col("l_returnflag").alias("label"), G.box(x1, y1, x1 + 20 + F.col("l_quantity"), y1 + 30 + F.col("l_quantity") / 2).alias("box"), F.lit(100).alias("image_width"), F.lit(80).alias("image_height"))


BOXES = f"""b AS (SELECT l_orderkey AS frame, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1)::INT AS idx, l_quantity / 50 AS score, l_returnflag AS label,
  (l_partkey % 7 * 10)::DOUBLE AS x1, (l_suppkey % 5 * 10)::DOUBLE AS y1, l_partkey % 7 * 10 + 20 + l_quantity AS x2, l_suppkey % 5 * 10 + 30 + l_quantity / 2 AS y2 FROM lineitem)"""


def poses(spark: SparkSession, d: str) -> DataFrame:
    """Two instances per vector, the second a jittered copy of lower score; five vectors a frame."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i, k: F.get("embedding", (i * 3 + k).cast("int")).cast("double")
    j = F.col("copy")
    kps = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct((at(i, 0) * 100 + 200 + j * 2).alias("x"), (at(i, 1) * 100 + 200 + j).alias("y"), F.greatest(F.least(at(i, 2) + 0.5, F.lit(1.0)), F.lit(0.0)).alias("score")))
    rows = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(F.floor(F.col("vec_id") / 5).alias("frame"), (F.col("vec_id") % 5 * 2 + j).cast("int").alias("idx"), (0.9 - F.col("vec_id") % 5 * 0.1 - j * 0.05).alias("score"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("box"), kps.alias("keypoints"))


POSES = """p AS (SELECT vec_id // 5 AS frame, (vec_id % 5 * 2 + copy)::INT AS idx, 0.9::DOUBLE - vec_id % 5 * 0.1::DOUBLE - copy * 0.05::DOUBLE AS score,
  list_transform(range(17), lambda i: {'x': embedding[3*i+1]::DOUBLE * 100 + 200 + copy * 2, 'y': embedding[3*i+2]::DOUBLE * 100 + 200 + copy, 'score': greatest(least(embedding[3*i+3]::DOUBLE + 0.5::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)}) AS kps
  FROM embeddings, (SELECT unnest([0, 1]) AS copy))"""


def _iou(a: str, b: str) -> str:
    w = f"greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0)"
    h = f"greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0)"
    u = f"(greatest({a}x2-{a}x1,0)*greatest({a}y2-{a}y1,0) + greatest({b}x2-{b}x1,0)*greatest({b}y2-{b}y1,0) - {w}*{h})"
    return f"CASE WHEN {u} > 0 THEN {w}*{h} / {u} ELSE 0 END"


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *[F.col("box")[n].alias(n) for n in ("x1", "y1", "x2", "y2")])


# --------------------------------------------------------------------------------------------------------- boxes


@query(f"WITH {BOXES} SELECT frame, idx, score, label FROM b WHERE score >= 0.3 AND lower(label) IN ('a', 'n', 'r') AND lower(label) NOT IN ('r')")
def q_conf_label_filter(spark, d):
    r = I.drop_reason(F.col("score"), F.col("label"), 0.3, ["A", "n", "R"], ["r"])
    return det_boxes(spark, d).withColumn("drop_reason", r).where("drop_reason is null").select("frame", "idx", "score", "label")


@query(f"WITH {BOXES} SELECT frame, count(*) AS input_count, count(*) FILTER (score < 0.3) AS dropped_confidence, count(*) FILTER (score >= 0.3 AND label = 'R') AS dropped_label, count(*) FILTER (score >= 0.3 AND label <> 'R') AS kept FROM b GROUP BY frame")
def q_filter_funnel_stats(spark, d):
    r = I.drop_reason(F.col("score"), F.col("label"), 0.3, None, ["R"])
    return I.funnel(det_boxes(spark, d).withColumn("drop_reason", r), ["frame"], ["confidence", "label"])


@query(f"WITH {BOXES} SELECT frame, idx, least(greatest(x1,0),60) AS x1, least(greatest(y1,0),50) AS y1, least(x2,60)-least(x1,60) AS w, least(y2,50)-least(y1,50) AS h, round((x2-x1)*(y2-y1), 2) AS area FROM b")
def q_box_area_xywh_clip(spark, d):
    b = G.clip(F.col("box"), F.lit(60), F.lit(50))
    rows = det_boxes(spark, d).withColumn("c", b).withColumn("v", G.to_xywh(F.col("c")))
    return rows.select("frame", "idx", F.col("v")[0].alias("x1"), F.col("v")[1].alias("y1"), F.col("v")[2].alias("w"), F.col("v")[3].alias("h"), F.round(G.area(F.col("box")), 2).alias("area"))


@query(f"""WITH {BOXES}, v AS (SELECT frame, idx, x1 AS a, y1 AS b, CASE WHEN idx % 2 = 0 THEN x2 ELSE x2 - x1 END AS c, CASE WHEN idx % 2 = 0 THEN y2 ELSE y2 - y1 END AS d FROM b),
f AS (SELECT *, CASE WHEN c <= a OR d <= b THEN 'xywh' ELSE 'xyxy' END AS fmt FROM v)
SELECT frame, idx, fmt, CASE WHEN fmt = 'xywh' THEN a + c ELSE c END AS x2, CASE WHEN fmt = 'xywh' THEN b + d ELSE d END AS y2, count(DISTINCT fmt) OVER (PARTITION BY frame) > 1 AS mixed FROM f""")
def q_auto_bbox_format(spark, d):
    b, odd = F.col("box"), F.col("idx") % 2 == 1
    v = F.array(b["x1"], b["y1"], F.when(odd, b["x2"] - b["x1"]).otherwise(b["x2"]), F.when(odd, b["y2"] - b["y1"]).otherwise(b["y2"]))
    rows = det_boxes(spark, d).withColumn("v", v).withColumn("fmt", G.auto_format(F.col("v"))).withColumn("c", G.from_list(F.col("v"), F.lit("auto")))
    mixed = F.size(F.collect_set("fmt").over(Window.partitionBy("frame"))) > 1
    return rows.select("frame", "idx", "fmt", F.col("c.x2").alias("x2"), F.col("c.y2").alias("y2"), mixed.alias("mixed"))


@query(f"""WITH {BOXES}, n AS (SELECT frame, idx, CASE WHEN frame % 2 = 0 THEN x1/200 ELSE x1 END AS x1, CASE WHEN frame % 2 = 0 THEN y1/200 ELSE y1 END AS y1, CASE WHEN frame % 2 = 0 THEN x2/200 ELSE x2 END AS x2, CASE WHEN frame % 2 = 0 THEN y2/200 ELSE y2 END AS y2 FROM b),
m AS (SELECT *, max(greatest(abs(x1),abs(y1),abs(x2),abs(y2))) OVER (PARTITION BY frame) <= 1.5 AS scaled FROM n)
SELECT frame, idx, scaled, CASE WHEN scaled THEN x1*100 ELSE x1 END AS x1, CASE WHEN scaled THEN y1*80 ELSE y1 END AS y1, CASE WHEN scaled THEN x2*100 ELSE x2 END AS x2, CASE WHEN scaled THEN y2*80 ELSE y2 END AS y2 FROM m""")
def q_coord_scale_normalized(spark, d):
    b = F.col("box")
    half = F.struct(*[F.when(F.col("frame") % 2 == 0, b[n] / 200).otherwise(b[n]).alias(n) for n in ("x1", "y1", "x2", "y2")])
    return _flat(I.scale_normalised(det_boxes(spark, d).withColumn("box", half), ["frame"]), "frame", "idx", "scaled")


@query(f"WITH {BOXES} SELECT DISTINCT frame, (ceil(max(x2) OVER (PARTITION BY frame)) + 1)::INT AS image_width, (ceil(max(y2) OVER (PARTITION BY frame)) + 1)::INT AS image_height FROM b")
def q_infer_image_size(spark, d):
    rows = det_boxes(spark, d).withColumns({"image_width": F.lit(None).cast("int"), "image_height": F.lit(None).cast("int")})
    return I.infer_size(rows, ["frame"]).select("frame", "image_width", "image_height").distinct()


@query(f"WITH {BOXES} SELECT p.frame, p.idx AS i, q.idx AS j, round({_iou('p.', 'q.')}, 6) AS iou FROM b p JOIN b q ON p.frame = q.frame AND p.idx < q.idx")
def q_box_iou_pairs(spark, d):
    rows = det_boxes(spark, d).select("frame", "idx", "box")
    return I.pairs_within(rows, ["frame"]).select("frame", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.round(G.iou(F.col("a.box"), F.col("b.box")), 6).alias("iou"))


def _nms_sql(same: str) -> str:
    return f"""WITH {BOXES}, g AS (SELECT frame, list({{'idx': idx, 'score': score, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, idx) AS a FROM b GROUP BY frame),
k AS (SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {same} ({_iou('k.', 'x[1].')}) > 0.5)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS e FROM g)
SELECT frame, e.idx AS idx, e.score AS score FROM k"""


@query(_nms_sql("k.label = x[1].label AND"))
def q_nms_box_class(spark, d):
    sim = lambda a, b: G.iou(a["box"], b["box"])
    return I.suppress(det_boxes(spark, d), ["frame"], sim, 0.5, ["box"], F.col("label")).select("frame", "idx", "score")


@query(_nms_sql(""))
def q_nms_box_agnostic(spark, d):
    sim = lambda a, b: G.iou(a["box"], b["box"])
    return I.suppress(det_boxes(spark, d), ["frame"], sim, 0.5, ["box"]).select("frame", "idx", "score")


@query(f"WITH {BOXES} SELECT frame, idx, id FROM (SELECT *, (row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) - 1)::INT AS id FROM b) WHERE id < 3")
def q_topk_score(spark, d):
    return I.top_k(det_boxes(spark, d), ["frame"], [F.desc("score"), F.col("idx")], 3).select("frame", "idx", "id")


@query(f"WITH {BOXES} SELECT frame, idx, id FROM (SELECT *, (row_number() OVER (PARTITION BY frame ORDER BY (x2-x1)*(y2-y1) DESC, idx) - 1)::INT AS id FROM b) WHERE id < 3")
def q_topk_area(spark, d):
    return I.top_k(det_boxes(spark, d).withColumn("area", G.area(F.col("box"))), ["frame"], [F.desc("area"), F.col("idx")], 3).select("frame", "idx", "id")


@query(f"WITH {BOXES} SELECT frame, label, first(idx ORDER BY score DESC, idx) AS idx, max(score) AS score, count(*) AS merged_from FROM b GROUP BY frame, label")
def q_merge_same_label(spark, d):
    return I.merge_by_label(det_boxes(spark, d), ["frame"]).select("frame", "label", "idx", "score", "merged_from")


@query(f"""WITH {BOXES}, f AS (SELECT * FROM b WHERE score >= 0.3), g AS (SELECT frame, list({{'idx': idx, 'score': score, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, idx) AS a FROM f GROUP BY frame),
k AS (SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.label = x[1].label AND ({_iou('k.', 'x[1].')}) > 0.7)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS e FROM g),
o AS (SELECT frame, (row_number() OVER (PARTITION BY frame ORDER BY e.score DESC, e.idx) - 1)::INT AS id, e.idx AS source_index, e.label AS label, round_even(e.score, 6) AS score, least(e.x1,100) AS x1, least(e.y1,80) AS y1, least(e.x2,100) AS x2, least(e.y2,80) AS y2 FROM k)
SELECT frame, id, source_index, label, score, round_even(x1,2) AS x1, round_even(y1,2) AS y1, round_even(x2,2) AS x2, round_even(y2,2) AS y2, round_even((x2-x1)*(y2-y1),2) AS area FROM o""")
def q_e2e_segmentation(spark, d):
    return pipelines.postprocess_boxes(det_boxes(spark, d), ["frame"], SegmentationParams())[0]


# ------------------------------------------------------------------------------------- frames without bound

#: Orders lie on a plane 250 wide; their boxes reach into the orders beside them where the step is smaller than a box.
PLANE = 250


def on_plane(spark, d, step: float) -> DataFrame:
    """The boxes of all orders in one frame."""
    b = F.col("box")
    dx, dy = F.col("frame") % PLANE * step, F.floor(F.col("frame") / PLANE) * step
    rows = det_boxes(spark, d).withColumns({"box": G.box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy), "idx": F.col("frame") * 64 + F.col("idx")})
    return rows.withColumns({"order": F.col("frame"), "frame": F.lit(0)})


@query(_nms_sql(""))
def q_nms_region(spark, d):
    """One frame of the whole table; boxes of different orders lie apart, so the result is that of each order alone."""
    rows = on_plane(spark, d, 200).withColumn("n", F.col("idx") - F.col("order") * 64)
    pairs = V.box_pairs(rows, ["frame"], 0.5, carry=["score"]).select("frame", *[F.col(f"{s}.{c}").alias(n) for s, c, n in (("a", "i", "i"), ("b", "i", "j"), ("a", "score", "si"), ("b", "score", "sj"))])
    return V.suppress_rounds(rows, ["frame"], pairs).select(F.col("order").alias("frame"), F.col("n").cast("int").alias("idx"), "score")


@query(f"""WITH {BOXES}, t AS (SELECT frame * 64 + idx AS idx, frame % {PLANE} AS tx, frame // {PLANE} AS ty, x1 + frame % {PLANE} * 100 AS x1, y1 + frame // {PLANE} * 100 AS y1, x2 + frame % {PLANE} * 100 AS x2, y2 + frame // {PLANE} * 100 AS y2 FROM b),
n AS (SELECT t.*, tx + dx AS nx, ty + dy AS ny FROM t, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
o AS (SELECT p.idx AS i, q.idx AS j, {_iou('p.', 'q.')} AS iou FROM n p JOIN t q ON p.nx = q.tx AND p.ny = q.ty AND p.idx < q.idx)
SELECT i, j, round(iou, 6) AS iou FROM o WHERE iou > 0.1""")
def q_region_box_pairs(spark, d):
    """Overlapping boxes of one frame, within orders and across."""
    return V.box_pairs(on_plane(spark, d, 100), ["frame"], 0.1).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), F.round("iou", 6).alias("iou"))


# --------------------------------------------------------------------------------------------------------- poses


@query(f"WITH {POSES}, v AS (SELECT frame, idx, list_filter(kps, lambda k: k.score >= 0.3 AND k.score > 0) AS s FROM p) SELECT frame, idx, len(s)::INT AS visible, round(CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda k: k.score)) / len(s) ELSE 0 END, 6) AS mean_score FROM v WHERE len(s) >= 3")
def q_kp_visibility(spark, d):
    rows = poses(spark, d).withColumn("keypoints", G.hide_below(F.col("keypoints"), 0.3)).withColumn("s", G.visible(F.col("keypoints")))
    mean = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0.0), lambda a, k: a + k["score"]) / F.size("s")).otherwise(0.0)
    return rows.where(F.size("s") >= 3).select("frame", "idx", F.size("s").alias("visible"), F.round(mean, 6).alias("mean_score"))


@query(f"""WITH {POSES}, v AS (SELECT frame, idx, list_filter(kps, lambda k: k.score > 0) AS s FROM p), m AS (SELECT frame, idx, list_min(list_transform(s, lambda k: k.x)) AS a, list_max(list_transform(s, lambda k: k.x)) AS c, list_min(list_transform(s, lambda k: k.y)) AS b, list_max(list_transform(s, lambda k: k.y)) AS d FROM v)
SELECT frame, idx, round(a-(c-a)*0.1,4) AS x1, round(b-(d-b)*0.1,4) AS y1, round(c+(c-a)*0.1,4) AS x2, round(d+(d-b)*0.1,4) AS y2 FROM m""")
def q_kp_bbox_padding(spark, d):
    rows = poses(spark, d).withColumn("box", G.hull(F.col("keypoints"), 0.1))
    return rows.select("frame", "idx", *[F.round(F.col("box")[n], 4).alias(n) for n in ("x1", "y1", "x2", "y2")])


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:51], lambda e: e::DOUBLE) AS f, list_transform(embedding[1:50], lambda e: e::DOUBLE) AS g FROM embeddings)
SELECT vec_id, 17::INT AS n3, round(f[4],6) AS x1, round(f[6],6) AS s1, 25::INT AS n2, round(g[3],6) AS x2, 1.0::DOUBLE AS s2 FROM v""")
def q_kp_parse_flat(spark, d):
    v = F.transform("embedding", lambda e: e.cast("double"))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", G.parse_flat(F.slice(v, 1, 51)).alias("t"), G.parse_flat(F.slice(v, 1, 50)).alias("u"))
    return rows.select("vec_id", F.size("t").alias("n3"), F.round(F.col("t")[1]["x"], 6).alias("x1"), F.round(F.col("t")[1]["score"], 6).alias("s1"), F.size("u").alias("n2"), F.round(F.col("u")[1]["x"], 6).alias("x2"), F.col("u")[1]["score"].alias("s2"))


_S = "[" + ", ".join(map(str, G.COCO17_SIGMAS)) + "]"
_AREA = "(SELECT frame, idx, score, kps, greatest((list_max(list_transform(list_filter(kps, lambda k: k.score > 0), lambda k: k.x)) - list_min(list_transform(list_filter(kps, lambda k: k.score > 0), lambda k: k.x))) * (list_max(list_transform(list_filter(kps, lambda k: k.score > 0), lambda k: k.y)) - list_min(list_transform(list_filter(kps, lambda k: k.score > 0), lambda k: k.y))), 1.0) AS area FROM p)"
OKS = f"""{POSES}, w AS {_AREA},
j AS (SELECT a.frame, a.idx AS i, b.idx AS j, a.score AS si, b.score AS sj, a.area AS ra, b.area AS rb, list_filter(list_transform(range(1, 18), lambda t: {{'on': a.kps[t].score > 0 AND b.kps[t].score > 0, 'd': (a.kps[t].x-b.kps[t].x)*(a.kps[t].x-b.kps[t].x) + (a.kps[t].y-b.kps[t].y)*(a.kps[t].y-b.kps[t].y), 'v': pow(2*({_S})[t]::DOUBLE, 2)}}), lambda z: z.on) AS z FROM w a JOIN w b ON a.frame = b.frame AND a.idx < b.idx),
o AS (SELECT frame, i, j, CASE WHEN len(z) > 0 THEN (list_sum(list_transform(z, lambda e: exp(-e.d/(e.v*greatest(ra,1)*2)))) / len(z) + list_sum(list_transform(z, lambda e: exp(-e.d/(e.v*greatest(rb,1)*2)))) / len(z)) / 2 ELSE 0 END AS oks FROM j)"""


@query(f"WITH {OKS} SELECT frame, i, j, round(oks, 5) AS oks FROM o")
def q_oks_pairs(spark, d):
    rows = poses(spark, d).select("frame", "idx", "keypoints", G.pose_area(F.col("box"), F.col("keypoints")).alias("area"))
    a, b = F.col("a"), F.col("b")
    return I.pairs_within(rows, ["frame"]).select("frame", a["idx"].alias("i"), b["idx"].alias("j"), F.round(G.oks(a["keypoints"], b["keypoints"], a["area"], b["area"]), 5).alias("oks"))


@query(f"""WITH {OKS}, c AS (SELECT frame, j, list(i) AS hits FROM o WHERE oks > 0.7 GROUP BY frame, j), g AS (SELECT p.frame, list({{'idx': p.idx, 'h': coalesce(c.hits, [])}} ORDER BY p.score DESC, p.idx) AS a FROM p LEFT JOIN c ON p.frame = c.frame AND p.idx = c.j GROUP BY p.frame)
SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e.idx]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: len(list_filter(a, lambda q: q.idx = x[1] AND list_contains(q.h, k))) > 0)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS idx FROM g""")
def q_nms_oks(spark, d):
    rows = poses(spark, d).withColumn("area", G.pose_area(F.col("box"), F.col("keypoints")))
    sim = lambda a, b: G.oks(a["keypoints"], b["keypoints"], a["area"], b["area"])
    return I.suppress(rows, ["frame"], sim, 0.7, ["keypoints", "area"]).select("frame", "idx")


def _angle_sql(a: int, v: int, b: int) -> str:
    k = lambda i, c: f"kps[{i + 1}].{c}"
    ux, uy, wx, wy = f"({k(a, 'x')}-{k(v, 'x')})", f"({k(a, 'y')}-{k(v, 'y')})", f"({k(b, 'x')}-{k(v, 'x')})", f"({k(b, 'y')}-{k(v, 'y')})"
    return f"CASE WHEN {k(a, 'score')} > 0 AND {k(v, 'score')} > 0 AND {k(b, 'score')} > 0 THEN round(degrees(acos(least(greatest(({ux}*{wx}+{uy}*{wy})/(sqrt({ux}*{ux}+{uy}*{uy})*sqrt({wx}*{wx}+{wy}*{wy})), -1), 1))), 2) END"


@query(f"WITH {POSES} SELECT frame, idx, {_angle_sql(5, 7, 9)} AS left_elbow, {_angle_sql(12, 14, 16)} AS right_knee FROM p")
def q_joint_angles(spark, d):
    k = F.col("keypoints")
    return poses(spark, d).select("frame", "idx", F.round(G.angle(k, 5, 7, 9), 2).alias("left_elbow"), F.round(G.angle(k, 12, 14, 16), 2).alias("right_knee"))


@query(f"""WITH {POSES.replace('p AS', 'every AS', 1)}, hidden AS (SELECT frame, idx, score, list_transform(kps, lambda k: {{'x': k.x, 'y': k.y, 'score': CASE WHEN k.score < 0.3 THEN 0.0::DOUBLE ELSE k.score END}}) AS kps FROM every WHERE score >= 0.3),
p AS (SELECT * FROM hidden WHERE len(list_filter(kps, lambda k: k.score > 0)) >= 3), {OKS[len(POSES) + 2:]}, c AS (SELECT frame, j, list(i) AS hits FROM o WHERE oks > 0.7 GROUP BY frame, j),
g AS (SELECT p.frame, list({{'idx': p.idx, 'h': coalesce(c.hits, [])}} ORDER BY p.score DESC, p.idx) AS a FROM p LEFT JOIN c ON p.frame = c.frame AND p.idx = c.j GROUP BY p.frame),
stays AS (SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e.idx]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: len(list_filter(a, lambda q: q.idx = x[1] AND list_contains(q.h, k))) > 0)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS idx FROM g),
s AS (SELECT *, list_filter(kps, lambda k: k.score > 0) AS s, row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) - 1 AS id FROM p SEMI JOIN stays USING (frame, idx))
SELECT frame, id::INT AS id, idx AS source_index, 'person' AS label, round_even(score, 6) AS score, len(s)::INT AS num_visible_keypoints, round_even(list_sum(list_transform(s, lambda k: k.score)) / len(s), 6) AS mean_keypoint_score,
  round_even(list_min(list_transform(s, lambda k: k.x)), 2) AS x1, round_even(list_min(list_transform(s, lambda k: k.y)), 2) AS y1, round_even(list_max(list_transform(s, lambda k: k.x)), 2) AS x2, round_even(list_max(list_transform(s, lambda k: k.y)), 2) AS y2,
  {', '.join(f'{_angle_sql(*t)} AS {n}' for n, t in G.COCO17_ANGLES)} FROM s WHERE id < 300""")
def q_e2e_pose(spark, d):
    out = pipelines.postprocess_poses(poses(spark, d), ["frame"], PoseParams(compute_angles=True))[0]
    return out.select(*[c for c in out.columns if c != "angles"], *[F.col("angles")[n].alias(n) for n, _ in G.COCO17_ANGLES])


# ------------------------------------------------------------------------------------------------------ temporal


def tracks(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("SELECT user_id, event_id, round(coalesce(0.6::DOUBLE * v + 0.4::DOUBLE * lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), v), 6) AS x FROM (SELECT *, coalesce(value, 0) AS v FROM events)")
def q_smooth_pairwise(spark, d):
    kps = F.array(F.struct(F.col("value").alias("x"), F.col("value").alias("y"), F.lit(1.0).alias("score")))
    out = S.smooth_pairwise(tracks(spark, d).withColumn("k", kps), ["user_id"], ["ts", "event_id"], "k", 0.6)
    return out.select("user_id", "event_id", F.round(F.col("k")[0]["x"], 6).alias("x"))


@query("""WITH g AS (SELECT user_id, list({'e': event_id, 'v': coalesce(value, 0)} ORDER BY ts, event_id) AS a FROM events GROUP BY user_id),
r AS (SELECT user_id, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda acc, x: list_concat(acc, [{'e': x[1].e, 'v': 0.6::DOUBLE * x[1].v + 0.4::DOUBLE * acc[-1].v}]))) AS s FROM g)
SELECT user_id, s.e AS event_id, round(s.v, 6) AS smoothed FROM r""")
def q_smooth_recursive(spark, d):
    out = S.smooth_recursive(tracks(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.6)
    return out.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {POSES} SELECT c.frame, c.idx, q.idx AS p_idx FROM p c LEFT JOIN p q ON q.frame = c.frame - 1 AND q.idx = c.idx""")
def q_track_match(spark, d):
    rows = poses(spark, d)
    cur = rows.select("frame", "idx", F.col("idx").alias("track_id"), "keypoints")
    prev = rows.select((F.col("frame") + 1).alias("frame"), F.col("idx").alias("p_idx"), F.col("idx").alias("p_track_id"), F.col("keypoints").alias("p_keypoints"))
    sim = G.oks(F.col("keypoints"), F.col("p_keypoints"), F.lit(1.0), F.lit(1.0))
    return S.match_previous(cur, prev, ["frame"], sim, 2.0).select("frame", "idx", "p_idx")


_CHAIN_OKS = f"list_filter(list_transform(range(1, 18), lambda t: CASE WHEN c.kps[t].score > 0 AND q.kps[t].score > 0 THEN exp(-((c.kps[t].x-q.kps[t].x)*(c.kps[t].x-q.kps[t].x) + (c.kps[t].y-q.kps[t].y)*(c.kps[t].y-q.kps[t].y)) / (pow(2*({_S})[t]::DOUBLE, 2)*greatest(c.area,1)*2)) END), lambda e: e IS NOT NULL)"
_CHAIN_BEST = f"list_max(list_transform(r.ans, lambda q, i: {{'o': coalesce(list_avg({_CHAIN_OKS}), 0), 't': (q.track IS NOT NULL)::INT, 'i': -i, 'k': q.kps}}))"
_CHAIN_SAME = "list_filter(r.ans, lambda q: q.track = c.track)"


@query(f"""WITH RECURSIVE {POSES}, w AS {_AREA}, v AS (SELECT *, CASE WHEN (frame + idx) % 4 > 0 THEN idx::VARCHAR END AS track FROM w WHERE frame % 11 <> 3 AND (frame * 7 + idx) % 5 > 0),
f AS (SELECT frame % 7 AS stream, frame, row_number() OVER (PARTITION BY frame % 7 ORDER BY frame) AS n, list({{'idx': idx, 'track': track, 'area': area, 'kps': kps, 'm': false}} ORDER BY idx) AS cur FROM v GROUP BY frame),
r AS (SELECT stream, frame, n, cur AS ans FROM f WHERE n = 1 UNION ALL
 SELECT f.stream, f.frame, f.n, list_transform(list_transform(f.cur, lambda c: {{'c': c, 'k': CASE WHEN len({_CHAIN_SAME}) > 0 THEN {_CHAIN_SAME}[-1].kps WHEN {_CHAIN_BEST}.o >= 0.5 THEN {_CHAIN_BEST}.k END}}),
  lambda z: {{'idx': z.c.idx, 'track': z.c.track, 'area': z.c.area, 'kps': CASE WHEN z.k IS NULL THEN z.c.kps ELSE list_transform(z.c.kps, lambda p, i: CASE WHEN p.score > 0 AND z.k[i].score > 0 THEN {{'x': 0.6::DOUBLE * p.x + 0.4::DOUBLE * z.k[i].x, 'y': 0.6::DOUBLE * p.y + 0.4::DOUBLE * z.k[i].y, 'score': p.score}} ELSE p END) END, 'm': z.k IS NOT NULL}})
 FROM r JOIN f ON f.stream = r.stream AND f.n = r.n + 1)
SELECT stream, frame, e.idx AS idx, e.m AS smoothed, round(list_sum(list_transform(e.kps, lambda k: k.x)), 4) AS sx, round(e.kps[1].y, 4) AS y0 FROM (SELECT stream, frame, unnest(ans) AS e FROM r)""")
def q_pose_chain(spark, d):
    """Seven streams of poses with missing frames, instances and track ids, each frame blended with the last answered one, in time slices."""
    n, i = F.col("frame"), F.col("idx")
    rows = poses(spark, d).where((n % 11 != 3) & ((n * 7 + i) % 5 > 0)).withColumns({"stream": n % 7, "track_id": F.when((n + i) % 4 > 0, i.cast("string")), "area": G.pose_area(F.col("box"), F.col("keypoints"))})
    cuts = [float(c) for c in rows.agg(F.percentile_approx("frame", [0.25, 0.5, 0.75])).head()[0]]
    k = F.col("keypoints")
    return K.smooth_poses(rows, "stream", "frame", sorted(set(cuts))).select("stream", n.cast("bigint").alias("frame"), i.cast("int").alias("idx"), "smoothed", F.round(F.aggregate(k, F.lit(0.0), lambda a, p: a + p["x"]), 4).alias("sx"), F.round(k[0]["y"], 4).alias("y0"))


# ------------------------------------------------------------------------------------------- payloads and routing


def payloads(spark, d) -> DataFrame:
    """Boxes written out as JSON in turn under three containers, as columns, as junk, and as nothing."""
    b = F.col("box")
    item = F.to_json(F.struct(F.col("score"), F.col("label").alias("class_name"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box")))
    rows = det_boxes(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("j"), "score", "label", F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("v")))).alias("a"))
    items = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]"))
    columns = F.to_json(F.struct(F.transform("a", lambda x: x["v"]).alias("boxes"), F.transform("a", lambda x: x["score"]).alias("scores"), F.transform("a", lambda x: x["label"]).alias("labels")))
    n = F.col("frame") % 7
    text = F.when(n == 0, items).when(n == 1, F.concat(F.lit('{"predictions":'), items, F.lit("}"))).when(n == 2, F.concat(F.lit('{"results":{"detections":'), items, F.lit("}}"))).when(n == 3, columns).when(n == 4, '{"nothing":"useful"}').when(n == 5, "{broken").otherwise("")
    return rows.select(F.col("frame").alias("frame_key"), text.alias("payload"))


@query(f"WITH {BOXES} SELECT frame AS frame_key, idx AS source_index, score, label, x1, y1, x2, y2 FROM b WHERE frame % 7 < 4")
def q_ingest_rows(spark, d):
    return _flat(P.read_instances(P.read_frames(payloads(spark, d)), bbox_format="xyxy"), "frame_key", "source_index", "score", "label")


@query("SELECT DISTINCT l_orderkey AS frame_key, CASE WHEN l_orderkey % 7 < 4 THEN 200 WHEN l_orderkey % 7 = 4 THEN 422 ELSE 400 END::INT AS status_code FROM lineitem")
def q_batch_isolation(spark, d):
    return P.read_frames(payloads(spark, d)).select("frame_key", F.col("status_code").cast("int").alias("status_code"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pose' WHEN 1 THEN 'segmentation' WHEN 2 THEN 'segmentation' WHEN 3 THEN 'pose' WHEN 4 THEN NULL ELSE 'segmentation' END AS task FROM part""")
def q_route_task(spark, d):
    n = F.col("p_partkey") % 6
    declared = F.when(n == 0, "Keypoints").when(n == 1, "detect")
    hint = F.when(n == 2, "segmentation")
    model = F.when(n == 3, "site-rtmpose-x").when(n == 4, "prod-discovered-base-trocr-ocr-serve-2").when(n == 5, "my-unet-9")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", P.route(declared, hint, model).alias("task"))


@query("""SELECT * FROM (VALUES ('discovered-yolo11-object-detection', 'detection'), ('discovered-base-detr-resnet-serve', 'detection'), ('discovered-base-detectron2-maskrcnn-serve', 'segmentation'),
('discovered-vc-yolov8-seg', 'segmentation'), ('discovered-base-yolov8n-pose-serve', 'pose'), ('discovered-base-yolov8n-pose-v2-serve', 'pose'), ('discovered-base-trocr-ocr-serve', 'ocr')) t(model_id, task)""")
def q_model_registry(spark, d):
    return spark.createDataFrame(sorted(P.MODELS), "model_id string, task string")


@query()
def q_params(spark, d):
    return params_table(spark)


# --------------------------------------------------------------------------------------------------------- masks


def rects(spark, d) -> DataFrame:
    """One rectangle per part as a polygon on a 64 x 64 canvas, eight to a frame."""
    x, y = (F.col("p_partkey") % 40).cast("double"), (F.col("p_size") % 30).cast("double")
    w, h = (F.col("p_partkey") % 13 + 3).cast("double"), (F.col("p_size") % 11 + 2).cast("double")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.floor(F.col("p_partkey") / 8).alias("frame"), F.col("p_partkey").alias("idx"), F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h)).alias("points"))


RECTS = "r AS (SELECT p_partkey // 8 AS frame, p_partkey AS idx, p_partkey % 40 AS x, p_size % 30 AS y, p_partkey % 13 + 3 AS w, p_size % 11 + 2 AS h FROM part)"


@query(f"WITH {RECTS} SELECT frame, idx, ((w + 0) * h)::BIGINT AS area, x::DOUBLE AS x1, y::DOUBLE AS y1, (x + w)::DOUBLE AS x2, (y + h)::DOUBLE AS y2 FROM r")
def q_polygon_fill(spark, d):
    masks = M.fill(rects(spark, d), ["frame", "idx"], 64, 64).withColumn("box", G.run_box(F.col("runs"))).withColumn("area", G.run_area(F.col("runs")))
    return _flat(masks, "frame", "idx", "area")


@query(f"""WITH {RECTS}, o AS (SELECT a.frame, a.idx AS i, b.idx AS j, greatest(least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y), 0) AS n, a.w*a.h + b.w*b.h AS s FROM r a JOIN r b ON a.frame = b.frame AND a.idx < b.idx)
SELECT frame, i, j, round(n::DOUBLE / (s - n), 6) AS iou FROM o WHERE n > 0""")
def q_mask_iou_pairs(spark, d):
    masks = M.fill(rects(spark, d), ["frame", "idx"], 64, 64)
    return M.overlap(masks, ["frame"]).select("frame", "i", "j", F.round("iou", 6).alias("iou"))


@query(f"WITH {RECTS} SELECT idx, (w * h)::BIGINT AS area, (CASE WHEN w * h = 64 * 64 THEN 1 ELSE 2 * w + 1 END)::INT AS n_counts FROM r")
def q_rle_roundtrip(spark, d):
    masks = M.fill(rects(spark, d), ["idx"], 64, 64).withColumn("c", M.encode_counts()(F.col("runs"), F.lit(64), F.lit(64)))
    again = masks.withColumn("c2", M.leb_decoded(M.leb_encoded(F.col("c")))).withColumn("spans", M.decode_counts(F.col("c2"), F.lit(64), F.lit(64)))
    return again.select("idx", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"]).alias("area"), F.size("c").alias("n_counts"))


@query(f"WITH {RECTS} SELECT idx, 1::INT AS components, (w * h)::BIGINT AS filled, CASE WHEN w * h >= 30 THEN (w * h)::BIGINT ELSE 0 END AS large, CASE WHEN (w-1)*(h-1) > sqrt((w-1)*(w-1) + (h-1)*(h-1)) THEN 4::INT END AS corners FROM r")
def q_mask_kernels(spark, d):
    """A rectangle whose corners lie within the tolerance of its diagonal simplifies to two points, so it has no polygon."""
    masks = M.fill(rects(spark, d), ["idx"], 64, 64)
    on = lambda f: f(F.col("runs"), F.lit(64), F.lit(64))
    return masks.select("idx", on(M.component_count()).alias("components"), G.run_area(on(M.fill_holes())).alias("filled"), G.run_area(on(M.drop_small(30))).alias("large"), (F.size(F.get(on(M.contours()), F.lit(0))) / 2).cast("int").alias("corners"))


@query("SELECT p_partkey, greatest(1, round_even((p_size * 100) * least(1.0, 1024.0 / greatest(p_size * 100, p_size * 60)), 0))::INT AS w, greatest(1, round_even((p_size * 60) * least(1.0, 1024.0 / greatest(p_size * 100, p_size * 60)), 0))::INT AS h FROM part")
def q_canvas_fit(spark, d):
    c = G.canvas(F.col("p_size") * 100, F.col("p_size") * 60, 1024)
    return spark.read.parquet(f"{d}/part.parquet").withColumn("c", c).select("p_partkey", "c.w", "c.h")


# ------------------------------------------------------------------------------------- masks, poses and batches whole

HOLED = "g AS (SELECT frame, idx, x, y, w, h, CASE WHEN w >= 5 AND h >= 4 THEN (w - 4) * (h - 2) ELSE 0 END AS hole, idx % 5 AS form FROM r)"


def holed(spark, d) -> DataFrame:
    """Rectangles with a hole where there is room for one, as JSON masks in turn as rings, counts, compressed counts, a bitmap, and raw bytes."""
    p = spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    x, y, w, h = (F.col(c) for c in "xywh")
    p = p.select(F.floor(F.col("p_partkey") / 8).alias("frame"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") % 40).cast("int").alias("x"), (F.col("p_size") % 30).cast("int").alias("y"), (F.col("p_partkey") % 13 + 3).cast("int").alias("w"), (F.col("p_size") % 11 + 2).cast("int").alias("h"))
    ring = lambda a, b, c, e: F.array(a, b, c, b, c, e, a, e)
    room = (w >= 5) & (h >= 4)
    rings = F.when(room, F.array(ring(x, y, x + w, y + h), ring(x + 2, y + 1, x + w - 2, y + h - 1))).otherwise(F.array(ring(x, y, x + w, y + h)))
    # a row without pixels, one across the rectangle, and one across its hole; the text of the canvas is made of their texts
    text = lambda zero, one, holed: F.concat(F.repeat(F.lit(zero), x), F.when(F.lit(holed) & room, F.concat(F.lit(one * 2), F.repeat(F.lit(zero), w - 4), F.lit(one * 2))).otherwise(F.repeat(F.lit(one), w)), F.repeat(F.lit(zero), 64 - x - w))
    down = lambda zero, one, line: F.concat(F.repeat(line(F.repeat(F.lit(zero), F.lit(64))), y), line(text(zero, one, False)), F.repeat(line(text(zero, one, True)), h - 2), line(text(zero, one, False)), F.repeat(line(F.repeat(F.lit(zero), F.lit(64))), 64 - y - h))
    rows = F.concat(F.lit("["), F.rtrim(down("0,", "1,", lambda t: F.concat(F.lit("["), F.rtrim(t, F.lit(",")), F.lit("],"))), F.lit(",")), F.lit("]"))
    column = F.transform(F.sequence(F.lit(0), w - 1), lambda c: F.when(room & (c >= 2) & (c < w - 2), F.array(F.lit(1), h - 2, F.lit(1), 64 - h)).otherwise(F.array(h, 64 - h)))
    runs = F.flatten(column)
    counts = F.concat(F.array(x * 64 + y), F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(64 * 64 - (x + w - 1) * 64 - y - h))
    form = F.col("idx") % 5
    p = p.withColumn("counts", F.when(form.isin(1, 2), F.transform(counts, lambda v: v.cast("bigint")))).withColumn("short", M.leb_encoded(F.when(form == 2, F.col("counts"))))
    size = F.array(F.lit(64), F.lit(64))
    raw = F.base64(F.unhex(down("00", "FF", lambda t: t)))
    mask = F.when(form == 0, F.to_json(rings)).when(form == 1, F.to_json(F.struct(size.alias("size"), "counts"))).when(form == 2, F.to_json(F.struct(size.alias("size"), F.col("short").alias("counts")))).when(form == 3, rows).otherwise(F.to_json(F.struct(F.regexp_replace(raw, "[\\r\\n]", "").alias("base64"), size.alias("size"))))
    return p.select("frame", "idx", "w", "h", mask.alias("mask"))


@query(f"WITH {RECTS}, {HOLED} SELECT idx, (w * h - hole)::BIGINT AS area, x::DOUBLE AS x1, y::DOUBLE AS y1, (x + w)::DOUBLE AS x2, (y + h)::DOUBLE AS y2 FROM g")
def q_mask_decode(spark, d):
    """Every encoding of a mask decodes to the same pixels."""
    side, half = F.lit(64), F.lit(0.5)
    rows = E.with_decoded(holed(spark, d), "mask", "m", side, side, side, side, half).withColumn("box", G.run_box(F.col("m.runs")))
    return _flat(rows.withColumn("area", G.run_area(F.col("m.runs"))), "idx", "area")


@query(f"WITH {RECTS}, {HOLED} SELECT idx, 1::INT AS components, (w * h)::BIGINT AS filled, CASE WHEN w * h - hole >= 60 THEN (w * h - hole)::BIGINT ELSE 0 END AS large, 2::INT AS middle FROM g WHERE form = 0 AND hole > 0 AND h > 4")
def q_mask_holes(spark, d):
    """Rings with a hole: one component, two runs in a middle row, no hole after filling."""
    side, half = F.lit(64), F.lit(0.5)
    rows = E.with_decoded(holed(spark, d).where("idx % 5 = 0 and w >= 5 and h > 4"), "mask", "m", side, side, side, side, half).withColumn("box", G.run_box(F.col("m.runs")))
    on = lambda f: f(F.col("m.runs"), side, side)
    middle = F.size(F.filter("m.runs", lambda r: r["y"] == (F.col("box.y1") + 1).cast("int")))
    return rows.select("idx", on(M.component_count()).alias("components"), G.run_area(on(M.fill_holes())).alias("filled"), G.run_area(on(M.drop_small(60))).alias("large"), middle.alias("middle"))


def mask_frames(spark, d) -> DataFrame:
    """frame_key and payload: the rectangles of a frame as instances with ring masks, eight to a frame."""
    r = rects(spark, d)
    points = F.flatten(F.transform("points", lambda q: F.array(q["x"], q["y"])))
    item = F.to_json(F.struct((F.col("idx") * 37 % 100 / 100).alias("score"), (F.col("idx") % 2).cast("string").alias("label"), F.array(points).alias("segmentation"), F.lit("north").alias("zone")))
    rows = r.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("j")))).alias("a"))
    items = F.array_join(F.transform("a", lambda q: q["j"]), ",")
    return rows.select(F.col("frame").cast("string").alias("frame_key"), F.concat(F.lit('{"image":{"width":64,"height":64},"predictions":['), items, F.lit("]}")).alias("payload"))


_RIOU = "(greatest(least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y), 0))"
_RI = _RIOU.format(a="k", b="x[1]")


@query(f"""WITH {RECTS}, s AS (SELECT *, idx * 37 % 100 / 100 AS score, (idx % 2)::VARCHAR AS label, (row_number() OVER (PARTITION BY frame ORDER BY idx) - 1)::INT AS si FROM r),
g AS (SELECT frame, list({{'si': si, 'score': score, 'label': label, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY score DESC, si) AS a FROM s WHERE score >= 0.3 GROUP BY frame),
k AS (SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.label = x[1].label AND {_RI} / (k.w*k.h + x[1].w*x[1].h - {_RI})::DOUBLE > 0.3)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS e FROM g)
SELECT frame::VARCHAR AS frame_key, (row_number() OVER (PARTITION BY frame ORDER BY e.score DESC, e.si) - 1)::INT AS id, e.si AS source_index, e.label AS label, e.score AS score, (e.w * e.h)::DOUBLE AS area, e.x::DOUBLE AS x1, (e.y + e.h)::DOUBLE AS y2, true AS has_mask, 'north' AS zone FROM k""")
def q_e2e_masks(spark, d):
    """Payloads to responses: decoding, suppression by masks, order, encoding, extra fields; instances are read back from the JSON."""
    out = R.run(mask_frames(spark, d), task="segmentation", iou_threshold=0.3).where("status_code = 200")
    rows = out.select("frame_key", F.explode(F.try_variant_get(F.try_parse_json("response"), "$.instances", "array<variant>")).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    return rows.select("frame_key", get("id", "int").alias("id"), get("source_index", "int").alias("source_index"), get("label", "string").alias("label"), get("score", "double").alias("score"), get("area", "double").alias("area"), get("bbox[0]", "double").alias("x1"), get("bbox[3]", "double").alias("y2"), get("has_mask", "boolean").alias("has_mask"), get("extra.zone", "string").alias("zone"))


def pose_frames(spark, d) -> DataFrame:
    item = F.to_json(F.struct("score", F.flatten(F.transform("keypoints", lambda k: F.array(k["x"], k["y"], k["score"]))).alias("keypoints")))
    rows = poses(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("j")))).alias("a"))
    items = F.array_join(F.transform("a", lambda q: q["j"]), ",")
    return rows.select(F.col("frame").cast("string").alias("frame_key"), F.concat(F.lit('{"image":{"width":100000,"height":100000},"poses":['), items, F.lit("]}")).alias("payload"))


_HIDDEN = POSES.replace("p AS (", "p0 AS (", 1) + """, p AS (SELECT frame, idx, score, list_transform(kps, lambda k: {'x': k.x, 'y': k.y, 'score': CASE WHEN k.score < 0.3 THEN 0.0::DOUBLE ELSE k.score END}) AS kps FROM p0)"""


@query(f"""WITH {OKS.replace(POSES, _HIDDEN)}, c AS (SELECT frame, j, list(i) AS hits FROM o WHERE oks > 0.7 GROUP BY frame, j),
g AS (SELECT p.frame, list({{'idx': p.idx, 'h': coalesce(c.hits, [])}} ORDER BY p.score DESC, p.idx) AS a FROM p LEFT JOIN c ON p.frame = c.frame AND p.idx = c.j GROUP BY p.frame),
k AS (SELECT frame, unnest(list_reduce(list_transform(a, lambda e: [e.idx]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: len(list_filter(a, lambda q: q.idx = x[1] AND list_contains(q.h, k))) > 0)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS idx FROM g),
v AS (SELECT p.frame, p.idx, p.score, list_filter(p.kps, lambda z: z.score > 0) AS s FROM p JOIN k ON p.frame = k.frame AND p.idx = k.idx)
SELECT frame::VARCHAR AS frame_key, (row_number() OVER (PARTITION BY frame ORDER BY score DESC, idx) - 1)::INT AS id, idx AS source_index, len(s)::INT AS visible, round_even(list_sum(list_transform(s, lambda z: z.score)) / len(s), 6) AS mean_score, round_even(list_min(list_transform(s, lambda z: z.x)), 2) AS x1, round_even(list_max(list_transform(s, lambda z: z.y)), 2) AS y2, 'person' AS label FROM v""")
def q_pose_frames(spark, d):
    """Payloads to pose responses: visibility, suppression by keypoint similarity, derived boxes; read back from the JSON."""
    out = R.run(pose_frames(spark, d), task="pose").where("status_code = 200")
    rows = out.select("frame_key", F.explode(F.try_variant_get(F.try_parse_json("response"), "$.instances", "array<variant>")).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    return rows.select("frame_key", get("id", "int").alias("id"), get("source_index", "int").alias("source_index"), get("num_visible_keypoints", "int").alias("visible"), get("mean_keypoint_score", "double").alias("mean_score"), get("bbox[0]", "double").alias("x1"), get("bbox[3]", "double").alias("y2"), get("label", "string").alias("label"))


@query("SELECT c_custkey AS batch_key, CASE WHEN c_custkey % 4 = 3 THEN 400 ELSE 200 END::INT AS status_code, CASE c_custkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 3 END::BIGINT AS count, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS failed FROM customer")
def q_batches(spark, d):
    """Envelopes of several items: a bad item fails alone, shared parameters reach every item, an item's own go first."""
    seg, kps = '{"predictions":[{"score":0.9,"bbox":[1,2,30,40]}]}', '{"task":"pose","poses":[{"score":0.9,"keypoints":[1,2,1,3,4,1,5,6,1]}]}'
    own = '{"predictions":[{"score":0.9,"bbox":[1,2,30,40]}],"params":{"confidence_threshold":0.2}}'
    n = F.col("c_custkey") % 4
    body = F.when(n == 0, f'{{"task":"segmentation","items":[{seg},{seg},{{"nothing":"useful"}}]}}').when(n == 1, f'[{{"task":"segmentation","predictions":[]}},{kps},{{"predictions":[]}}]').when(n == 2, f'{{"model_id":"discovered-vc-yolov8-seg","params":{{"confidence_threshold":7}},"frames":[{seg},{seg}]}}').otherwise(f'{{"items":[],"batch":{own}}}')
    return R.run_batches(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("batch_key"), body.alias("body")))[1].select("batch_key", F.col("status_code").cast("int").alias("status_code"), "count", "failed")


# ------------------------------------------------------------------------------------------------ runs without bitmaps

_CUT = lambda v, n, k: f"((2 * ({v}) * {k} + {n} - 1) // {2 * n})"
_TO = "(SELECT unnest([{'tw': 150, 'th': 97}, {'tw': 23, 'th': 41}, {'tw': 64, 'th': 1}]) AS t)"


@query(f"""WITH {RECTS}, m AS (SELECT idx, t.tw AS tw, {_CUT('x', 64, 't.tw')} AS a, {_CUT('x + w', 64, 't.tw')} AS b, {_CUT('y', 64, 't.th')} AS c, {_CUT('y + h', 64, 't.th')} AS e FROM r, {_TO})
SELECT idx, tw::INT AS to_width, ((b - a) * (e - c))::BIGINT AS area, CASE WHEN b > a THEN e - c ELSE 0 END::INT AS n_runs FROM m""")
def q_mask_resample(spark, d):
    """Runs moved to larger, smaller and one-row canvases in column expressions."""
    masks = M.fill(rects(spark, d), ["idx"], 64, 64)
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in [(150, 97), (23, 41), (64, 1)]]))
    out = masks.withColumn("to", each).withColumn("out", N.resampled(F.col("runs"), F.lit(64), F.lit(64), F.col("to.w"), F.col("to.h")))
    return out.select("idx", F.col("to.w").alias("to_width"), F.aggregate("out", F.lit(0).cast("bigint"), lambda n, r: n + r["x1"] - r["x0"]).alias("area"), F.size("out").alias("n_runs"))


@query(f"WITH {RECTS} SELECT idx, (w * h * 4096)::BIGINT AS area, (2 * 64 * w + 1)::INT AS n_counts, (64 * x * 4096 + 64 * y)::BIGINT AS lead, (64 * h)::INT AS n_runs, (64 * x)::INT AS x0, (64 * y + 64 * h - 1)::INT AS last FROM r")
def q_mask_turn(spark, d):
    """Rectangles on a canvas of 4096 x 4096 to column-major counts and back to rows, in memory of their runs."""
    p = spread(rects(spark, d), "idx").select("idx", F.col("points")[0].alias("a"), F.col("points")[2].alias("b"))
    runs = F.transform(F.sequence((F.col("a.y") * 64).cast("int"), (F.col("b.y") * 64 - 1).cast("int")), lambda y: F.struct(y.alias("y"), (F.col("a.x") * 64).cast("int").alias("x0"), (F.col("b.x") * 64).cast("int").alias("x1")))
    side = F.lit(4096)
    rows = p.select("idx", runs.alias("runs")).withColumn("counts", M.encode_counts()(F.col("runs"), side, side)).withColumn("mask", F.to_json(F.struct(F.array(side, side).alias("size"), "counts")))
    back = E.with_decoded(rows, "mask", "d", side, side, side, side, F.lit(0.5)).withColumn("r", F.col("d.runs"))
    return back.select("idx", G.run_area(F.col("r")).cast("bigint").alias("area"), F.size("counts").alias("n_counts"), F.get("counts", F.lit(0)).alias("lead"), F.size("r").alias("n_runs"), F.get("r", F.lit(0))["x0"].alias("x0"), F.try_element_at("r", F.lit(-1))["y"].alias("last"))


@query(f"WITH {RECTS} SELECT idx, CASE WHEN idx % 7 > 0 THEN (w * h)::DOUBLE END AS area, CASE WHEN idx % 7 > 0 THEN x::DOUBLE END AS x1, CASE WHEN idx % 7 > 0 THEN (y + h)::DOUBLE END AS y2, idx % 7 = 0 AS unknown FROM r")
def q_mask_images(spark, d):
    """PNG images of five kinds (grey, one bit, palette, colour with alpha, sixteen bits) under three names; a cut one says nothing."""
    masks = M.fill(rects(spark, d), ["idx"], 64, 64).withColumn("image", M.as_png()(F.col("runs"), F.lit(64), F.lit(64), F.col("idx") % 5))
    text = F.base64(F.when(F.col("idx") % 7 > 0, F.col("image")).otherwise(F.substring("image", 1, 60)))
    text = F.regexp_replace(text, "[\\r\\n]", "")
    form = F.col("idx") % 3
    mask = F.when(form == 0, F.to_json(F.struct(text.alias("png")))).when(form == 1, F.to_json(F.struct(F.concat(F.lit("data:image/png;base64,"), text).alias("base64")))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    side = F.lit(64)
    out = E.with_decoded(masks.select("idx", mask.alias("mask")), "mask", "d", side, side, side, side, F.lit(0.5)).withColumn("box", G.run_box(F.col("d.runs")))
    return out.select("idx", F.when(F.col("d.runs").isNotNull(), G.run_area(F.col("d.runs")).cast("double")).alias("area"), F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), F.col("d.unknown").alias("unknown"))


def in_tiles(runs: DataFrame, side: int) -> DataFrame:
    """Runs (y, x0, x1) cut at the borders of tiles."""
    cells = F.sequence(F.floor(F.col("x0") / side), F.floor((F.col("x1") - 1) / side))
    rest = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return runs.withColumn("t", F.explode(cells)).select(*rest, "y", F.greatest("x0", (F.col("t") * side).cast("int")).alias("x0"), F.least("x1", (F.col("t") * side + side).cast("int")).alias("x1"))


@query(f"""WITH RECURSIVE {RECTS}, e AS (SELECT a.frame, a.idx AS i, b.idx AS j FROM r a JOIN r b ON a.frame = b.frame AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h),
c AS (SELECT frame, i, j FROM e UNION SELECT c.frame, c.i, e.j FROM c JOIN e ON c.frame = e.frame AND c.j = e.i),
g AS (SELECT frame, i, min(j) AS root FROM c GROUP BY frame, i),
p AS (SELECT DISTINCT r.frame, g.root, (y + dy) * 64 + x + dx AS px FROM r JOIN g ON r.frame = g.frame AND r.idx = g.i, unnest(range(h)) AS a(dy), unnest(range(w)) AS b(dx))
SELECT frame, (min(px) // 64)::INT AS cy, (min(px) % 64)::INT AS cx, count(*)::BIGINT AS area FROM p GROUP BY frame, root""")
def q_mask_parts(spark, d):
    """Components of the union of a frame's masks, whose runs come cut by tiles of 8 columns."""
    runs = N.exploded(M.fill(rects(spark, d), ["frame", "idx"], 64, 64), ["frame"])
    parts = N.components(in_tiles(N.united(runs, ["frame"]), 8), ["frame"])
    return parts.groupBy("frame", "cy", "cx").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


@query(f"WITH {RECTS} SELECT idx, (w * h)::BIGINT AS area, h::BIGINT AS n_runs FROM r")
def q_mask_closed(spark, d):
    """Rectangles with holes, cut by tiles of 8 columns, are whole again once holes are filled."""
    runs = N.exploded(E.with_decoded(holed(spark, d), "mask", "m", F.lit(64), F.lit(64), F.lit(64), F.lit(64), F.lit(0.5)).select("idx", "m.runs"), ["idx"])
    whole = N.without_holes(in_tiles(runs, 8), ["idx"], F.lit(64), F.lit(64))
    return whole.groupBy("idx").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.count("*").alias("n_runs"))


@query("""SELECT p_partkey::VARCHAR AS frame_key, CASE WHEN p_partkey % 3 = 0 THEN '2' ELSE '1' END AS batch, CASE WHEN p_partkey % 3 <> 0 AND p_size % 5 = 0 THEN 422 ELSE 200 END::INT AS status_code,
CASE WHEN p_partkey % 3 = 0 OR p_size % 5 > 0 THEN p_name END AS response, CASE WHEN p_partkey % 3 <> 0 AND p_size % 5 = 0 THEN p_type END AS error FROM part""")
def q_sink(spark, d):
    """Two batches of responses, the first written twice, read back from the shared folder: a frame once, as its last batch has it."""
    p = spark.read.parquet(f"{d}/part.parquet")
    bad = F.col("p_size") % 5 == 0
    made = lambda rows, bad: rows.select(F.col("p_partkey").cast("string").alias("frame_key"), F.when(bad, 422).otherwise(200).alias("status_code"), F.lit(1).alias("n_instances"), F.when(~bad, F.col("p_name")).alias("response"), F.when(bad, F.col("p_type")).alias("error"))
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    for _ in range(2):
        sink.write(made(p, bad), folder, "1")
    sink.write(made(p.where("p_partkey % 3 = 0"), F.lit(False)), folder, "2")
    return sink.read(spark, folder).select("frame_key", "batch", "status_code", "response", "error")
