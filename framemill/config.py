"""Parameters of the two pipelines with defaults and ranges; environment variables give site defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INSTANCES, MAX_ITEMS, DEFAULT_SIZE = 2000, 64, (1920, 1080)


def _env(name: str, default: float):
    """A number from the environment; a malformed one falls back."""

    def read():
        try:
            return type(default)(os.environ.get(name, default))
        except ValueError:
            return default

    return read


def _p(default, low=None, high=None, choices=None, env=None, above=None):
    meta = {"low": low, "high": high, "choices": choices, "above": above}
    return field(default_factory=_env(env, default), metadata=meta) if env else field(default=default, metadata=meta)


@dataclass(frozen=True)
class CommonParams:
    confidence_threshold: float = _p(0.30, 0, 1, env="CONFIDENCE_THRESHOLD")
    max_detections: int = _p(300, 1, 10000, env="MAX_DETECTIONS")
    allowed_labels: tuple[str, ...] | None = None
    denied_labels: tuple[str, ...] | None = None
    class_agnostic_nms: bool = False
    clip_to_image: bool = True
    bbox_format: str = _p("auto", choices=("auto", "xyxy", "xywh", "cxcywh"))
    coordinate_space: str = _p("auto", choices=("auto", "pixel", "normalized"))
    keep_extra_fields: bool = True
    sort_by: str = _p("score", choices=("score", "area", "none"))

    def __post_init__(self):
        wrong = []
        for f in fields(self):
            v, m = getattr(self, f.name), f.metadata
            if v is not None and ((m.get("low") is not None and v < m["low"]) or (m.get("above") is not None and v <= m["above"]) or (m.get("high") is not None and v > m["high"]) or (m.get("choices") and v not in m["choices"])):
                wrong.append(f"{f.name}={v!r}")
        if wrong:
            raise ValueError("out of range: " + ", ".join(wrong))


@dataclass(frozen=True)
class SegmentationParams(CommonParams):
    iou_threshold: float = _p(0.70, 0, 1, env="IOU_THRESHOLD")
    nms: str = _p("mask", choices=("mask", "box", "none"))
    mask_binarize_threshold: float = _p(0.5, 0, 1)
    mask_max_side: int = _p(1024, 64, 4096, env="MASK_MAX_SIDE")
    min_area: float = _p(0.0, 0)
    min_area_ratio: float = _p(0.0, 0, 1)
    max_area_ratio: float = _p(1.0, 0, 1)
    min_component_area: float = _p(0.0, 0)
    fill_holes: bool = False
    merge_same_label: bool = False
    simplify_tolerance: float = _p(1.0, 0)
    output_mask: str = _p("polygon", choices=("polygon", "rle", "both", "none"))
    bbox_from_mask: bool = True
    require_mask: bool = False


@dataclass(frozen=True)
class PoseParams(CommonParams):
    keypoint_threshold: float = _p(0.30, 0, 1, env="KEYPOINT_THRESHOLD")
    oks_threshold: float = _p(0.70, 0, 1, env="OKS_THRESHOLD")
    iou_threshold: float = _p(0.70, 0, 1, env="IOU_THRESHOLD")
    nms: str = _p("oks", choices=("oks", "box", "none"))
    min_visible_keypoints: int = _p(3, 0)
    drop_invisible_keypoints: bool = False
    bbox_mode: str = _p("auto", choices=("auto", "keypoints", "given", "none"))
    bbox_padding: float = _p(0.0, 0, 1)
    include_skeleton: bool = True
    compute_angles: bool = False
    layout: str = "coco17"
    smoothing: bool = False
    alpha: float = _p(0.6, 0, 1)
    max_jump: float | None = _p(None, above=0)
    match_threshold: float = _p(0.5, 0, 1)


#: Where a parameter lies in a request, if not under its own name.
PATHS = {"smoothing": "smoothing.enabled", "alpha": "smoothing.alpha", "max_jump": "smoothing.max_jump", "match_threshold": "smoothing.match_threshold"}


#: What an invalid parameter is answered with.
NUMBER, NO_NUMBER = "Input should be a valid number", "Input should be a valid number, unable to parse string as a number"
INTEGER, NO_INTEGER, FRACTION = "Input should be a valid integer", "Input should be a valid integer, unable to parse string as an integer", "Input should be a valid integer, got a number with a fractional part"
BOOLEAN, NO_BOOLEAN = "Input should be a valid boolean", "Input should be a valid boolean, unable to interpret input"
STRING, LIST, EXTRA = "Input should be a valid string", "Input should be a valid list", "Extra inputs are not permitted"
LAYOUT, NESTED = "Input should be a valid string or dictionary", "Input should be a valid dictionary or instance of SmoothingParams"
AT_LEAST, AT_MOST, ABOVE = "Input should be greater than or equal to %s", "Input should be less than or equal to %s", "Input should be greater than %s"
WRONG = "array<struct<param:string,message:string,received:string>>"


def _received(v: Column) -> Column:
    """A value as it is quoted in an error: strings in quotes, True, False, None, numbers and containers as they are."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(F.is_variant_null(v), "None").when(kind == "STRING", F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "BOOLEAN", F.initcap(text)).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").cast("string")).otherwise(text)


def _choices(names: tuple[str, ...]) -> str:
    quoted = [f"'{n}'" for n in names]
    return f"Input should be {', '.join(quoted[:-1])} or {quoted[-1]}"


def _kind(f, base: CommonParams) -> str:
    return "array<string>" if f.name.endswith("_labels") else {bool: "boolean", int: "int", str: "string"}.get(type(getattr(base, f.name)), "double")


def _checked(f, base: CommonParams, v: Column) -> tuple[Column, Column]:
    """(value or null, message or null) of a stated VARIANT for a field."""
    m, kind, of = f.metadata, _kind(f, base), F.schema_of_variant(v)
    text, real = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    shown = lambda x: f"{x:g}"
    if f.name == "layout":
        return text, F.when(~((of == "STRING") | of.startswith("OBJECT")), LAYOUT)
    if kind == "array<string>":
        items = F.try_variant_get(v, "$", "array<variant>")
        odd = F.exists(items, lambda x: F.schema_of_variant(x) != "STRING")
        return F.try_variant_get(v, "$", "array<string>"), F.when(items.isNull(), LIST).when(odd, STRING)
    if kind == "boolean":
        low = F.lower(text)
        on, off = low.isin("true", "1", "1.0", "yes", "on", "y", "t"), low.isin("false", "0", "0.0", "no", "off", "n", "f")
        scalar = ~(of.startswith("OBJECT") | of.startswith("ARRAY"))
        return F.when(on, True).when(off, False), F.when(~scalar, BOOLEAN).when(~(on | off), NO_BOOLEAN)
    if kind == "string":
        return text, F.when((of != "STRING") | ~text.isin(*m["choices"]), _choices(m["choices"]))
    integral = kind == "int"
    bad = F.when(of == "STRING", NO_INTEGER if integral else NO_NUMBER).otherwise(INTEGER if integral else NUMBER)
    steps = F.when(real.isNull(), bad)
    if integral:
        steps = steps.when(real != F.floor(real), F.when(of == "STRING", NO_INTEGER).otherwise(FRACTION))
    if m.get("low") is not None:
        steps = steps.when(real < m["low"], AT_LEAST % shown(m["low"]))
    if m.get("above") is not None:
        steps = steps.when(real <= m["above"], ABOVE % shown(m["above"]))
    if m.get("high") is not None:
        steps = steps.when(real > m["high"], AT_MOST % shown(m["high"]))
    return real.try_cast(kind), steps


def frame_params(params: str, base: CommonParams, frames: DataFrame) -> DataFrame:
    """frames with p: a struct of all parameters from the JSON object in column params (base has what it leaves out), and
    wrong, a list of param, message and received for what is invalid. Frames that state nothing have constants."""
    rows = frames.withColumn("_stated", F.when(F.col(params) != "{}", F.try_parse_json(params)))
    smoothing = F.try_variant_get("_stated", "$.smoothing", "variant")
    nested = F.try_variant_get(smoothing, "$", "map<string,variant>")
    none = lambda v: v.isNull() | F.is_variant_null(v)
    error = lambda param, message, v: F.when(message.isNotNull(), F.struct(F.lit(param).alias("param"), message.alias("message"), _received(v).alias("received")))
    values, wrong = [], []
    for f in fields(base):
        default, kind, path = getattr(base, f.name), _kind(f, base), PATHS.get(f.name, f.name)
        usual = F.lit(None if default is None else list(default) if isinstance(default, tuple) else default).cast(kind)
        if path == f.name or f.name in PATHS and isinstance(base, PoseParams):
            v = F.try_variant_get("_stated", f"$.{path}", "variant")
            value, message = _checked(f, base, v)
            values.append(F.when(F.col("_stated").isNull() | none(v), usual).otherwise(value.cast(kind)).alias(f.name))
            wrong.append(error(path, F.when(F.col("_stated").isNotNull() & ~none(v), message), v))
    if isinstance(base, PoseParams):
        known = [p.split(".")[1] for p in PATHS.values()]
        more = F.transform(F.filter(F.map_entries(nested), lambda e: ~e["key"].isin(known)), lambda e: F.struct(F.concat(F.lit("smoothing."), e["key"]).alias("param"), F.lit(EXTRA).alias("message"), _received(e["value"]).alias("received")))
        wrong.append(error("smoothing", F.when(~none(smoothing) & nested.isNull(), NESTED), smoothing))
    else:
        more = F.array().cast(WRONG)
    rows = rows.withColumn("_wrong", F.when(F.col("_stated").isNotNull(), F.concat(F.array_compact(F.array(*wrong)), F.coalesce(more.cast(WRONG), F.array().cast(WRONG)))).otherwise(F.array().cast(WRONG)))
    return rows.withColumn("p", F.struct(*values, F.col("_wrong").alias("wrong"))).drop("_stated", "_wrong")


def params_table(spark: SparkSession) -> DataFrame:
    """(task, name, default) of every parameter."""
    rows = [(task, f.name, str(getattr(kind(), f.name))) for task, kind in (("segmentation", SegmentationParams), ("pose", PoseParams)) for f in fields(kind)]
    return spark.createDataFrame(rows, "task string, name string, default_value string")
