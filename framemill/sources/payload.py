"""Loosely structured JSON payloads to frames and instances, in column expressions.

A payload is a list of objects, or an object that holds one under a known key (an empty list counts), perhaps nested
in objects up to MAX_DEPTH deep, or as a last resort under any key if its first object has a score or a box; or parallel
arrays. It is parsed once, to VARIANT; an object is then a map of members, a list an array of variants. Where the order of
keys matters (the last resort), it is read from the text. What can't be read becomes an error row with a status code,
never an exception.

Defined beyond the plain cases: a name that occurs twice in an object, a bare NaN or Infinity, and anything behind the
value make invalid JSON (400); an image side below 1 counts as unknown if it truncates to 0 and else, like one beyond
32 bits, is an error (422); a box or keypoint that holds no number fails its frame (500), not its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Keys that payloads use, in order of preference.
LIST_KEYS = ["instances", "predictions", "detections", "segments", "poses", "keypoints_results", "results", "objects", "outputs", "output", "items", "data"]
SCORE_KEYS = ["score", "confidence", "conf", "probability", "prob", "det_score"]
LABEL_KEYS = ["label", "class_name", "category_name", "category", "name", "class", "cls_name"]
LABEL_ID_KEYS = ["label_id", "class_id", "category_id", "cls", "class_idx", "index"]
BOX_KEYS = ["bbox", "box", "bounding_box", "bbox_xyxy", "xyxy", "rect", "boundingBox"]
MASK_KEYS = ["mask", "segmentation", "seg", "mask_rle", "polygons", "polygon", "contours", "mask_polygon"]
KEYPOINT_KEYS = ["keypoints", "kpts", "pose", "landmarks", "joints", "points"]
COLUMN_KEYS = {"bbox": ["boxes", "bboxes", "xyxy", "rects"], "score": ["scores", "confidences", "confs", "probabilities"], "label": ["labels", "classes", "class_ids", "class_names", "categories"], "mask": ["masks", "segmentations", "segments", "polygons"], "keypoints": ["keypoints", "kpts", "poses", "landmarks"]}
MAX_DEPTH = 4
TRACK_KEYS = ["track_id", "id", "instance_id", "object_id", "tracker_id"]
RESERVED = {*SCORE_KEYS, *LABEL_KEYS, *LABEL_ID_KEYS, *BOX_KEYS, *MASK_KEYS, *KEYPOINT_KEYS, *TRACK_KEYS, "bbox_format", "area", "segmentation_format"}
SIZE_KEYS = ["image", "image_size", "frame", "meta", "metadata", "info", "original_size", "orig_shape"]
SHAPE_KEYS = ["shape", "size", "image_shape"]
WIDTH_KEYS, HEIGHT_KEYS = ["width", "w", "image_width"], ["height", "h", "image_height"]
FRAME_WIDTH_KEYS, FRAME_HEIGHT_KEYS = ["width", "image_width", "img_width", "frame_width"], ["height", "image_height", "img_height", "frame_height"]
PASSED_KEYS = ["frame_id", "frame_index", "timestamp", "source", "stream_id", "camera_id"]
PARAM_KEYS = ["params", "postprocess_params", "options", "config"]
SNIFF_KEYS = ["instances", "predictions", "detections", "results", "outputs", "poses", "segments"]
POSE_MARKS, MASK_MARKS = ["keypoints", "kpts", "landmarks", "joints"], ["mask", "segmentation", "polygons", "contours"]
POSE_HINTS = ["pose", "keypoint", "kpt", "hrnet", "openpose", "movenet", "blazepose", "rtmpose"]
SEGMENTATION_HINTS = ["seg", "mask", "maskrcnn", "sam", "deeplab", "unet", "panoptic", "instance-seg"]
#: Model ids with their tasks. An id that contains one (or is contained in one) has its task, first match first.
MODELS = [
    ("discovered-yolo11-object-detection", "detection"),
    ("discovered-base-detr-resnet-serve", "detection"),
    ("discovered-base-detectron2-maskrcnn-serve", "segmentation"),
    ("discovered-vc-yolov8-seg", "segmentation"),
    ("discovered-base-yolov8n-pose-serve", "pose"),
    ("discovered-base-yolov8n-pose-v2-serve", "pose"),
    ("discovered-base-trocr-ocr-serve", "ocr"),
]
TASK_NAMES = {"pose": ["pose", "keypoint", "keypoints", "pose_estimation", "keypoint_detection"], "segmentation": ["segmentation", "segment", "instance_segmentation", "semantic_segmentation", "mask"], "detection": ["detection", "object_detection", "detect"]}


#: Names a box object may use for its corners, or its corner and size.
CORNERS = [("xyxy", ["x1", "y1", "x2", "y2"]), ("xyxy", ["left", "top", "right", "bottom"]), ("xywh", ["x", "y", "width", "height"]), ("xywh", ["x", "y", "w", "h"])]
#: Where an object of keypoints holds them, and what a keypoint's score is called.
POINT_LISTS, POINT_SCORES = ["keypoints", "points", "landmarks", "data"], ["score", "confidence", "v", "visibility"]
MAX_SIDE = (1 << 31) - 1
POINTS = "array<struct<x:double,y:double,score:double>>"


# ------------------------------------------------------------------------------------------------- members of a VARIANT


def parsed(text: Column) -> Column:
    """The one JSON value that a text holds, null for any other text."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(alone) == 1, F.get(alone, F.lit(0)))


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def numbers(v: Column) -> Column:
    """number() of each element of a list; one of plain numbers is read from its text at once."""
    plain = lambda t: F.when(t.rlike(r"^\[[0-9.eE+,-]*\]$"), F.from_json(t, "array<double>"))
    return F.coalesce(let(F.try_variant_get(v, "$", "string"), plain), F.try_variant_get(v, "$", "array<double>"))


def number_rows(v: Column) -> Column:
    """numbers() of each element of a list; a row that is no list is null."""
    plain = lambda t: F.when(t.rlike(r"^\[\[[\[\]0-9.eE+,-]*\]\]$"), F.from_json(t, "array<array<double>>"))
    return F.coalesce(let(F.try_variant_get(v, "$", "string"), plain), F.try_variant_get(v, "$", "array<array<double>>"))


def given(v: Column) -> Column:
    """v unless it is JSON's null."""
    return F.when(~F.is_variant_null(v), v)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def text_of(v: Column) -> Column:
    """A value as text: strings as they are, true and false capitalised, fractions with their point, others as JSON."""
    kind, plain = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), number(v).cast("string")).otherwise(plain)


def named(m: Column, names: list[str]) -> Column:
    """The first member under one of the names that isn't null; then the first whose name in lower case is one."""
    exact = [given(F.try_element_at(m, F.lit(n))) for n in names]
    odd = F.filter(F.map_entries(m), lambda e: (F.lower(e["key"]) != e["key"]) & ~F.is_variant_null(e["value"]))
    of = lambda n, entries: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    lowered = F.get(F.filter(F.transform(words(names), lambda n: of(n, odd)), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(*exact, F.when(F.size(odd) > 0, lowered))


def has_any(m: Column, names: list[str]) -> Column:
    """Whether a member under one of the names, in any case, isn't null."""
    return F.exists(F.map_entries(m), lambda e: (e["key"].isin(names) | F.lower(e["key"]).isin(names)) & ~F.is_variant_null(e["value"]))


def overlaid(*maps: Column) -> Column:
    """One map of all members, of equal names the last."""
    every = F.flatten(F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:variant>>")) for m in maps]))
    last = lambda entries: F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return let(every, lambda entries: F.map_from_entries(last(entries)))


# ---------------------------------------------------------------------------------------------------------- frames


def _objects(a: Column, path: Column) -> Column:
    """A list and its path, if it is empty or begins with an object."""
    return F.when((F.size(a) == 0) | as_map(F.get(a, F.lit(0))).isNotNull(), F.struct(a.alias("items"), path.alias("path")))


NODE = "struct<up:int,rank:int,path:string,at:string,m:map<string,variant>>"


def with_found(rows: DataFrame, m: str, text: str, at: Column) -> DataFrame:
    """rows with _found: the list that the object in column m holds, and its path. text and at (a JSON path) give the order of keys.

    Objects below known keys are nodes, a column of them for each depth. From the deepest up, a node's list is that of
    its first known key that holds one, where an object counts if its own list isn't empty, else the last resort.
    """

    def below(n: Column, i: Column) -> Column:
        child = lambda k, j: F.struct(i.alias("up"), j.alias("rank"), F.concat(n["path"], k, F.lit(".")).alias("path"), F.concat(n["at"], F.lit("."), k).alias("at"), as_map(F.try_element_at(n["m"], k)).alias("m"))
        return F.filter(F.transform(words(LIST_KEYS), child), lambda c: c["m"].isNotNull())

    def listed(n: Column) -> Column:
        own = F.transform(words(LIST_KEYS), lambda k, j: F.struct(j.alias("rank"), as_list(F.try_element_at(n["m"], k)).alias("items"), F.concat(n["path"], k).alias("path")))
        return F.get(F.filter(own, lambda x: (F.size(x["items"]) == 0) | as_map(F.get(x["items"], F.lit(0))).isNotNull()), F.lit(0))

    def resort(n: Column) -> Column:
        keys = F.json_object_keys(F.call_function("get_json_object", F.col(text), n["at"]))
        item = lambda k: as_map(F.get(as_list(F.try_element_at(n["m"], k)), F.lit(0)))
        key = F.get(F.filter(keys, lambda k: let(item(k), lambda o: o.isNotNull() & has_any(o, SCORE_KEYS + BOX_KEYS))), F.lit(0))
        return let(key, lambda k: F.struct(F.lit(len(LIST_KEYS)).alias("rank"), as_list(F.try_element_at(n["m"], k)).alias("items"), F.concat(n["path"], k).alias("path")))

    def result(n: Column, i: Column, under: str | None) -> Column:
        inner = F.get(F.filter(under, lambda c: (c["up"] == i) & (F.size(c["items"]) > 0)), F.lit(0)) if under else F.lit(None)
        inner = F.when(F.size(under) > 0, F.struct(inner["rank"].alias("rank"), inner["items"].alias("items"), inner["path"].alias("path"))) if under else listed(n)
        first = lambda c, o: F.when(c["items"].isNotNull() & (o["items"].isNull() | (c["rank"] < o["rank"])), c).when(o["items"].isNotNull(), o).otherwise(resort(n))
        best = let(F.struct(inner.alias("c"), listed(n).alias("o")), lambda z: first(z["c"], z["o"]))
        return let(best, lambda r: F.struct(n["up"].alias("up"), n["rank"].alias("rank"), r["items"].alias("items"), r["path"].alias("path")))

    root = F.when(F.col(m).isNotNull(), F.array(F.struct(F.lit(0).alias("up"), F.lit(0).alias("rank"), F.lit("").alias("path"), at.alias("at"), F.col(m).alias("m"))))
    rows = rows.withColumn("_n0", root.cast(f"array<{NODE}>"))
    for d in range(MAX_DEPTH):
        rows = rows.withColumn(f"_n{d + 1}", F.flatten(F.transform(f"_n{d}", below)))
    for d in range(MAX_DEPTH, -1, -1):
        under = f"_r{d + 1}" if d < MAX_DEPTH else None
        rows = rows.withColumn(f"_r{d}", F.transform(f"_n{d}", lambda n, i: result(n, i, under)))
    found = F.when(F.size("_r0") > 0, F.get("_r0", F.lit(0)))
    out = rows.withColumn("_found", F.struct(found["items"].alias("items"), found["path"].alias("path")))
    return out.drop(*(f"_{c}{d}" for c in "nr" for d in range(MAX_DEPTH + 1)))


def columns_of(m: Column) -> Column:
    """Parallel arrays as objects, as long as the longest; null without any array."""
    col = {k: as_list(named(m, names)) for k, names in COLUMN_KEYS.items()}

    def objects(c: Column) -> Column:
        n = F.greatest(*[F.coalesce(F.size(c[k]), F.lit(0)) for k in col])
        cell = lambda k, i: F.get(c[k], i)
        is_text = lambda i: F.schema_of_variant(cell("label", i)) == "STRING"
        one = lambda i: F.to_variant_object(F.struct(*[cell(k, i).alias(k) for k in col if k != "label"], F.when(is_text(i), cell("label", i)).alias("label"), F.when(~is_text(i), cell("label", i)).alias("class_id")))
        some = F.exists(F.array(*[c[k].isNotNull() for k in col]), lambda x: x)
        return F.when(some, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<variant>")))

    return let(F.struct(*[v.alias(k) for k, v in col.items()]), objects)


def image_size(m: Column) -> Column:
    """(w, h) as the payload states it; lists hold the height first, sides of 0 say nothing."""
    pair = lambda w, h: F.when((F.abs(w) >= 1) & (F.abs(h) >= 1), F.struct(w.alias("w"), h.alias("h")))
    of_list = lambda a: pair(number(F.get(a, F.lit(1))), number(F.get(a, F.lit(0))))
    of_map = lambda o: pair(number(named(o, WIDTH_KEYS)), number(named(o, HEIGHT_KEYS)))
    either = lambda v: F.coalesce(let(as_map(v), of_map), of_list(as_list(v)))
    under = lambda keys, f: F.get(F.filter(F.transform(words(keys), lambda k: f(F.try_element_at(m, k))), lambda s: s.isNotNull()), F.lit(0))
    flat = pair(number(named(m, FRAME_WIDTH_KEYS)), number(named(m, FRAME_HEIGHT_KEYS)))
    return F.coalesce(under(SIZE_KEYS, either), flat, under(SHAPE_KEYS, lambda v: of_list(as_list(v))))


def hint_of(m: Column) -> Column:
    """The task that the first object of a known list shows, or parallel arrays at the top."""
    marks = lambda o, names: F.exists(words(names), lambda k: F.map_contains_key(o, k))
    shown = lambda o: F.when(marks(o, POSE_MARKS), "pose").when(marks(o, MASK_MARKS), "segmentation").otherwise("")
    of_key = lambda k: let(as_map(F.get(as_list(F.try_element_at(m, k)), F.lit(0))), lambda o: F.when(o.isNotNull(), shown(o)))
    first = F.get(F.filter(F.transform(words(SNIFF_KEYS), of_key), lambda t: t.isNotNull()), F.lit(0))
    top = F.when(as_list(F.try_element_at(m, F.lit("keypoints"))).isNotNull(), "pose").when(as_list(F.try_element_at(m, F.lit("masks"))).isNotNull(), "segmentation")
    return F.nullif(F.coalesce(first, top), F.lit(""))


def _stated(m: Column, names: list[str]) -> Column:
    """The first member under one of the names that is a text with something in it."""
    return F.coalesce(*[F.nullif(F.try_variant_get(F.try_element_at(m, F.lit(n)), "$", "string"), F.lit("")) for n in names])


def read_frames(frames: DataFrame, key: str = "frame_key", payload: str = "payload", max_instances: int = 2000) -> DataFrame:
    """Frame headers: items (array of variants), container, image size, frame_id, model_id, params and passed (JSON), previous, declared task, hint, error and status_code."""
    text = F.col(payload)
    rows = frames.withColumn("_body", parsed(text)).withColumn("_top", as_map(F.col("_body")))
    top, with_params = F.col("_top"), F.exists(words(PARAM_KEYS), lambda k: F.map_contains_key("_top", k))
    inner = F.when(with_params, given(F.try_element_at(top, F.lit("payload"))))
    rows = rows.withColumns({"_inner": inner}).withColumns({"_v": F.coalesce("_inner", "_body")}).withColumns({"_list": as_list(F.col("_v")), "_m": as_map(F.col("_v"))})
    m = F.col("_m")
    at = F.when(F.col("_inner").isNotNull(), "$.payload").otherwise("$")
    rows = with_found(rows, "_m", payload, at)
    rows = rows.withColumn("_found", F.when(F.col("_list").isNotNull(), _objects(F.col("_list"), F.lit(None).cast("string"))).otherwise(F.col("_found")))
    none = F.array().cast("array<variant>")
    known = F.exists(words(LIST_KEYS), lambda k: F.map_contains_key("_m", k))
    rows = rows.withColumn("_columns", F.when(m.isNotNull() & (F.coalesce(F.size("_found.items"), F.lit(0)) <= 0), columns_of(m)))
    rows = rows.withColumns({
        "items": F.coalesce("_columns", "_found.items", F.when(known, none)), "container": F.when(F.col("_columns").isNotNull(), "columnar").otherwise(F.col("_found.path")), "_size": F.when(m.isNotNull(), image_size(m)),
        "_params": overlaid(*[as_map(F.try_element_at(top, F.lit(k))) for k in PARAM_KEYS]), "_passed": F.map_filter(m, lambda k, v: k.isin(PASSED_KEYS)), "hint": hint_of(top),
    })
    passed, params = F.col("_passed"), F.col("_params")
    previous = F.when(F.map_contains_key("_params", "previous"), F.try_element_at(params, F.lit("previous"))).otherwise(F.try_element_at(top, F.lit("previous")))
    frame_id = F.when(F.map_contains_key("_passed", "frame_id"), F.try_element_at(passed, F.lit("frame_id"))).otherwise(F.try_element_at(passed, F.lit("frame_index")))
    side = lambda n: F.when(F.col(f"_size.{n}").between(1, MAX_SIDE), F.col(f"_size.{n}").cast("int"))
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    odd = F.col("_size").isNotNull() & (side("w").isNull() | side("h").isNull())
    error = F.when(empty, "empty body").when(F.col("_body").isNull(), "invalid JSON").when(F.col("items").isNull(), "no predictions found").when(F.size("items") > max_instances, "too many instances").when(odd, "image size out of range")
    rows = rows.withColumns({
        "image_width": side("w"), "image_height": side("h"), "frame_id": F.to_json(given(frame_id)), "model_id": text_of(named(m, ["model_id", "model", "model_name"])), "declared_task": _stated(top, ["task", "task_type"]), "asked_model": _stated(top, ["model_id", "model", "model_name"]),
        "params": F.coalesce(F.to_json(F.map_filter(params, lambda k, v: k != "previous")), F.lit("{}")), "previous": given(previous), "passed": F.coalesce(F.to_json(passed), F.lit("{}")), "error": error,
    })
    status = F.when(F.col("error").isin("empty body", "invalid JSON"), 400).when(F.col("error") == "too many instances", 413).when(F.col("error").isNotNull(), 422).otherwise(200)
    return rows.withColumn("status_code", status).drop("_body", "_top", "_inner", "_v", "_list", "_m", "_found", "_columns", "_size", "_params", "_passed")


# -------------------------------------------------------------------------------------------------------- instances


def box_of(v: Column, fmt: Column) -> Column:
    """box, its kind, and bad (a side that is no number) of an object with named sides or a list of four numbers."""

    def of(kind: Column, n: Column) -> Column:
        return F.struct(F.when(~F.exists(n, lambda x: x.isNull()), G.from_list(n, kind)).alias("box"), kind.alias("kind"), F.exists(n, lambda x: x.isNull()).alias("bad"))

    def sides(m: Column) -> Column:
        every = F.array(*[F.struct(F.lit(kind).alias("kind"), words(names).alias("names")) for kind, names in CORNERS])
        full = F.get(F.filter(every, lambda c: F.forall(c["names"], lambda k: F.map_contains_key(m, k))), F.lit(0))
        return let(full, lambda c: F.when(c.isNotNull(), of(c["kind"], F.transform(c["names"], lambda k: number(F.try_element_at(m, k))))))

    by_list = lambda n: of(F.when(fmt.isin("xyxy", "xywh", "cxcywh"), fmt).otherwise(G.auto_format(n)), n)
    four = lambda a: F.when(F.size(a) >= 4, let(F.transform(F.slice(a, 1, 4), number), by_list))
    return F.coalesce(let(as_list(v), four), let(as_map(v), lambda m: F.when(m.isNotNull(), sides(m))))


def unwrapped(v: Column) -> Column:
    """What an object holds under the first name for a list of keypoints that it has; anything else as it is."""
    under = lambda m: F.try_element_at(m, F.get(F.filter(words(POINT_LISTS), lambda k: F.map_contains_key(m, k)), F.lit(0)))
    return F.coalesce(let(as_map(v), under), v)


def keypoints_of(v: Column) -> Column:
    """points (null if there are none) and bad (a coordinate that is no number) of any list of keypoints."""
    point = lambda x, y, s: F.struct(x.alias("x"), y.alias("y"), s.alias("score"))

    def of_map(m: Column) -> Column:
        stated = lambda names: F.get(F.filter(words(names), lambda k: F.map_contains_key(m, k)), F.lit(0))
        member = lambda names, none: let(stated(names), lambda k: F.when(k.isNull(), F.lit(none)).otherwise(number(F.try_element_at(m, k))))
        score = let(stated(POINT_SCORES), lambda k: F.when(k.isNull() | given(F.try_element_at(m, k)).isNull(), F.lit(1.0)).otherwise(number(F.try_element_at(m, k))))
        return point(member(["x", "X"], 0.0), member(["y", "Y"], 0.0), score)

    def of_list(a: Column) -> Column:
        n = F.transform(a, number)
        some = F.when(F.size(a) > 2, point(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.get(n, F.lit(2)))).when(F.size(a) == 2, point(F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.lit(1.0)))
        return F.struct(some.alias("p"), (a.isNull() | F.exists(n, lambda x: x.isNull())).alias("bad"))

    whole = lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | p["score"].isNull()
    result = lambda points, bad: F.struct(F.when((F.size(points) > 0) & ~F.coalesce(bad, F.lit(False)), points).cast(POINTS).alias("points"), F.coalesce(bad, F.lit(False)).alias("bad"))
    objects = lambda a: let(F.transform(a, lambda p: let(as_map(p), lambda m: F.when(m.isNotNull(), of_map(m)))), lambda ps: result(ps, F.exists(ps, whole)))
    lists = lambda a: let(F.transform(a, lambda p: of_list(as_list(p))), lambda ps: result(F.filter(F.transform(ps, lambda p: p["p"]), lambda p: p.isNotNull()), F.exists(ps, lambda p: p["bad"])))
    flat = lambda a: let(F.transform(a, number), lambda n: result(G.parse_flat(n), F.exists(n, lambda x: x.isNull())))
    kind = lambda a: F.when(as_map(F.get(a, F.lit(0))).isNotNull(), objects(a)).when(as_list(F.get(a, F.lit(0))).isNotNull(), lists(a)).otherwise(flat(a))
    return let(as_list(v), lambda a: F.when(F.size(a) > 0, kind(a)))


def read_instances(headers: DataFrame, key: str = "frame_key", bbox_format: str | Column = "auto") -> DataFrame:
    """Instances of the readable frames; elements that aren't objects are skipped but keep their place. bbox_format: a name or a column of headers.

    bad marks an instance whose box or keypoints hold no numbers: its frame fails.
    """
    wanted = F.lit(bbox_format) if isinstance(bbox_format, str) else bbox_format
    # an outer explode, for a filter on the headers would be pushed below the search and repeat it
    rows = headers.select(key, "image_width", "image_height", wanted.alias("_wanted"), F.posexplode_outer(F.when(F.col("error").isNull(), F.col("items"))).alias("source_index", "v"))
    rows = rows.withColumn("_m", as_map(F.col("v"))).where("_m is not null")
    m = F.col("_m")
    # each probe of the payload is a column of its own, so that no later expression repeats it
    rows = rows.withColumns({
        "_fmt": F.coalesce(F.nullif(text_of(given(F.try_element_at(m, F.lit("bbox_format")))), F.lit("")), F.col("_wanted")),
        "_score": named(m, SCORE_KEYS), "_label": named(m, LABEL_KEYS), "_id": named(m, LABEL_ID_KEYS), "_box": named(m, BOX_KEYS), "_mask": named(m, MASK_KEYS), "_points": named(m, KEYPOINT_KEYS), "_track": named(m, TRACK_KEYS),
        "_extra": F.map_filter(m, lambda k, x: ~k.isin(*RESERVED) & ~F.lower(k).isin(*RESERVED)),
    })
    kind, text = F.schema_of_variant("_id"), F.trim(F.try_variant_get("_id", "$", "string"))
    whole = F.when(kind == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))).when(kind == "BIGINT", F.try_variant_get("_id", "$", "bigint")).otherwise(number(F.col("_id")).try_cast("bigint"))
    rows = rows.withColumns({"_b": box_of(F.col("_box"), F.col("_fmt")), "_points": unwrapped(F.col("_points")), "_whole": whole})
    rows = rows.withColumn("_points", unwrapped(F.col("_points"))).withColumn("_k", keypoints_of(F.col("_points")))
    return rows.select(
        key, "source_index", "image_width", "image_height",
        F.coalesce(number(F.col("_score")), F.lit(1.0)).alias("score"),
        F.coalesce(text_of(F.col("_label")), F.when(F.col("_whole").isNull(), text_of(F.col("_id")))).alias("label"),
        F.col("_whole").alias("label_id"), "_b.box", F.when(F.col("_b.box").isNotNull(), F.col("_b.kind")).alias("box_format"), F.col("_k.points").alias("keypoints"),
        text_of(F.col("_track")).alias("track_id"), F.to_json("_track").alias("track"), F.to_json("_mask").alias("mask"), F.when(F.size("_extra") > 0, F.to_json("_extra")).alias("extra"),
        (F.coalesce("_b.bad", F.lit(False)) | F.coalesce("_k.bad", F.lit(False))).alias("bad"),
    )


def task_of_model(model_id: Column, models=MODELS) -> Column:
    key = F.lower(F.trim(model_id))
    out = F.when(F.coalesce(key, F.lit("")) == "", None)
    for stem, task in models:
        out = out.when(key.contains(stem) | F.lit(stem).contains(key), task)
    return out.when(key.rlike("|".join(POSE_HINTS)), "pose").when(key.rlike("|".join(SEGMENTATION_HINTS)), "segmentation")


def route(declared: Column, hint: Column, model_id: Column) -> Column:
    """pose or segmentation: the declared task, then the payload's hint, then the model; detection runs as segmentation, others as null."""
    named = []
    for c in (declared, hint):
        low, case = F.lower(F.trim(c)), None
        for task, names in TASK_NAMES.items():
            case = F.when(low.isin(names), task) if case is None else case.when(low.isin(names), task)
        named.append(case)
    task = F.coalesce(*named, task_of_model(model_id))
    return F.when(task == "detection", "segmentation").when(task.isin("pose", "segmentation"), task)


def previous_of(v: Column) -> Column:
    """The instances of a previous frame (VARIANT: a response, its instances, or bare keypoints): an array of track and points."""
    m = as_map(v)
    under = F.filter(F.transform(words(["instances", "detections", "predictions"]), lambda k: as_list(F.try_element_at(m, k))), lambda a: F.size(a) > 0)
    own = lambda m: F.get(F.filter(F.transform(words(["keypoints", "keypoints_flat"]), lambda k: F.try_element_at(m, k)), lambda x: F.size(as_list(x)) > 0), F.lit(0))
    parts = lambda x: let(as_map(x), lambda m: F.struct(text_of(given(F.try_element_at(m, F.lit("track_id")))).alias("track"), F.when(m.isNotNull(), own(m)).otherwise(x).alias("k")))
    one = lambda x: let(parts(x), lambda p: F.struct(p["track"].alias("track"), keypoints_of(p["k"])["points"].alias("points")))
    return F.transform(F.coalesce(as_list(v), F.get(under, F.lit(0))), one)


def merged_params(shared: Column, own: Column) -> Column:
    """JSON of both objects' members, those of own first."""
    return F.when(shared.isNull() | (shared == "{}"), own).otherwise(F.to_json(overlaid(as_map(parsed(shared)), as_map(parsed(own)))))


def read_envelopes(batches: DataFrame, body: str) -> DataFrame:
    """batches with items (JSON texts; null if the body holds none) and what the envelope says for all of them: task, model, shared (JSON)."""
    text = F.col(body)
    rows = batches.withColumn("_v", parsed(text)).withColumn("_m", as_map(F.col("_v")))
    m = F.col("_m")
    full = F.get(F.filter(words(["items", "frames", "batch"]), lambda k: F.size(as_list(F.try_element_at("_m", k))) > 0), F.lit(0))
    rows = rows.withColumns({"_key": full, "_shared": as_map(F.try_element_at(m, F.lit("params")))})
    shared = F.when(F.size("_shared") > 0, F.to_json("_shared"))
    items = F.from_json(F.when(m.isNull(), text).otherwise(F.call_function("get_json_object", text, F.concat(F.lit("$."), F.col("_key")))), "array<string>")
    items = F.when(as_list(F.col("_v")).isNotNull() | F.col("_key").isNotNull(), items)
    rows = rows.withColumns({"task": _stated(m, ["task", "task_type"]), "model": _stated(m, ["model_id", "model"]), "shared": shared, "items": items})
    # what is no object is laid under a key of its own where there are parameters to add
    lay = lambda t: F.when(F.col("shared").isNotNull() & ~t.startswith("{"), F.concat(F.lit('{"predictions":'), t, F.lit("}"))).otherwise(t)
    return rows.withColumn("items", F.transform("items", lambda t: F.coalesce(lay(t), F.lit("null")))).drop("_v", "_m", "_key", "_shared")
