"""Decontamination gives every row its own result, in one slice of items or several: repeated, clashing and null ids, null item ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framemill.llm import decontaminate

A, B, C = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
ROWS = [(1, f"x {A} y"), (1, f"x {A} y"), (1, f"clean text and {B}"), (1, "clean"), (None, f"{C} z"), (None, "clean too"), (None, None), (2, f"{A} {B}"), (3, "")]
ITEMS = [("i", A), ("j", B), (None, C), ("k", " ".join(A.split()[5:19] + ["q"])), ("j", A), ("l", None)]


def plain(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("size", [1 << 20, 100, 10])
def test_rows(spark, size):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = decontaminate.find_contamination(docs, bench, slice_bytes=size)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated(), "ranges").collect()
    assert plain(r[:6] for r in got) == plain(decontaminate.brute_force(ROWS, ITEMS))
    # ranges are disjoint in both paths; the null item counts as a hit without a name
    assert all(sum(r.ranges[1::2]) - sum(r.ranges[::2]) == r.n_hit and r.ranges == sorted(set(r.ranges)) for r in got)
    assert [(r.n_hit, r.n_items) for r in got if r.doc_id is None and r.n_hit] == [(20, 0)]


def test_slices_one_at_a_time(spark, monkeypatch):
    """The next slice is compiled only when the one before has been searched and its broadcast released."""
    seen = []
    compile_items, save = decontaminate.compile_items, decontaminate.Scratch.save
    monkeypatch.setattr(decontaminate, "compile_items", lambda g, w: seen.append(sum(len(t) for _, t in g)) or compile_items(g, w))
    monkeypatch.setattr(decontaminate.Scratch, "save", lambda self, df, name: seen.append(name) or save(self, df, name))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    decontaminate.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id string, text string"), slice_bytes=100)
    assert seen[0] == "rows" and len(seen) > 3
    assert all(n <= 100 for n in seen[1::2]) and set(seen[2::2]) == {"hits"}


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_stage_keeps_clean_rows_of_a_shared_id(spark, tmp_path, monkeypatch, size):
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    find = decontaminate.find_contamination
    monkeypatch.setattr(corpus_pipeline.decontaminate, "find_contamination", lambda *a, **k: find(*a, slice_bytes=size, **k))
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    clean = [(r[0], r[1], "s") for r, b in zip(ROWS, decontaminate.brute_force(ROWS, ITEMS)) if not b[-1]]
    assert sorted(got, key=str) == sorted(clean, key=str)
