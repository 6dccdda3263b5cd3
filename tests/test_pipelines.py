from framemill.config import SegmentationParams
from framemill.plans import pipelines

ROWS = [(1, 0, 0.9, "a", (0.0, 0.0, 10.0, 10.0), 50, 50), (1, 1, 0.8, "a", (20.0, 0.0, 30.0, 10.0), 50, 50), (1, 2, 0.7, "b", (0.0, 20.0, 10.0, 30.0), 50, 50), (1, 3, 0.1, "b", (0.0, 0.0, 9.0, 9.0), 50, 50)]
SCHEMA = "frame long, idx int, score double, label string, box struct<x1:double,y1:double,x2:double,y2:double>, image_width int, image_height int"


def run(spark, **p):
    out, stats = pipelines.postprocess_boxes(spark.createDataFrame(ROWS, SCHEMA), ["frame"], SegmentationParams(**p))
    return sorted((r.id, r.source_index) for r in out.collect()), stats.collect()[0].asDict()


def test_box_rules(spark):
    assert run(spark)[0] == [(0, 0), (1, 1), (2, 2)]
    assert run(spark, merge_same_label=True)[0] == [(0, 0), (1, 2)]
    assert run(spark, nms="none", min_area=1e9)[0] == [(0, 0), (1, 1), (2, 2)]  # the rule is about masks
    kept, stats = run(spark, require_mask=True)
    assert kept == [] and stats == {"frame": 1, "input_count": 4, "dropped_confidence": 1, "dropped_label": 0, "dropped_no_mask": 3, "kept": 0}
