"""The registered pipeline, stage by stage, against brute force, on a small table with null, repeated and clashing ids."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from framemill.llm import curriculum, decontaminate, jaccard
from framemill.session import ship

rng = random.Random(9)
WORDS = [f"word{i}" for i in range(300)]
LONG = rng.choices(WORDS, k=120)
ITEM = " ".join(f"test{i}" for i in range(20))


def text(k):
    return " ".join(rng.choices(WORDS, k=k))


def near(k):
    w = list(LONG)
    for _ in range(k):
        w[rng.randrange(120)] = f"new{rng.randrange(999)}"
    return " ".join(w)


TEXTS = [None, "", " \n ", "one", " ".join(LONG), " ".join(LONG), *[near(k) for k in (1, 2, 3, 9)], f"{text(5)} {ITEM} {text(5)}", f"{ITEM} {text(2000)}", *[f"{text(20)} vile scum {text(9)}" if i % 4 == 0 else text(30) for i in range(160)]]
ROWS = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "extra") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[30], ROWS[30], (31, "another text of the same id and more words", "en", "s1", 1, "x"), (None, text(40), "en", "s1", 1, "x"), (None, text(40), "en", "s2", 1, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    ship(spark)
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile scum" in (t or ""))) for i, t in enumerate(TEXTS) if i > 11], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plain(df):
    return sorted((tuple(r) for r in df.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()), key=repr)


def test_toxicity(spark, tables):
    got = plain(C.drop_toxic(spark, spark.createDataFrame(ROWS, SCHEMA), tables))
    gone = sorted(set(ROWS) - set(got), key=repr)
    assert all("vile scum" in r[1] for r in gone) and len(gone) >= 30
    assert not set(got) - set(ROWS) and got.count(ROWS[30]) == 3


def test_near_copies(spark, tables):
    got = plain(C.drop_near_copies(spark, spark.createDataFrame(ROWS, SCHEMA), tables))
    # brute force by row number: of each group with words the row with the smallest id stays
    classes = {r: c for r, _, c in jaccard.brute_force([(k, r[1]) for k, r in enumerate(ROWS)], 5, (4, 5))}
    groups = {}
    for k, r in enumerate(ROWS):
        groups.setdefault(classes[k] if (r[1] or "").split() else ("none", k), []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    assert got == sorted(want, key=repr)


def test_benchmark(spark, tables):
    got = plain(C.drop_contaminated(spark, spark.createDataFrame(ROWS, SCHEMA), tables))
    bad = [b[-1] for b in decontaminate.brute_force([(k, r[1]) for k, r in enumerate(ROWS)], [(1, ITEM), (2, None)])]
    assert got == sorted((r for r, b in zip(ROWS, bad) if not b), key=repr) and sum(bad) == 1


def test_mixing(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = plain(C.mix(spark, docs, tables))
    size = {r: len((r[1] or "").encode().split()) for r in ROWS}
    target = {r["source"]: r.target for r in curriculum.plan(docs.select("doc_id", "source", "text"), ["doc_id"]).select("source", "target").distinct().collect()}
    for s in {r[3] for r in ROWS}:
        taken = sum(size[r] for r in got if r[3] == s)
        assert abs(taken - target[s]) <= max(size[r] for r in ROWS if r[3] == s)
    assert all(got.count(r) <= 3 * ROWS.count(r) for r in got) and not set(got) - set(ROWS) and any(r[0] is None for r in got)
    assert plain(C.mix(spark, docs, tables)) == got


def test_sharding(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = C.shard(spark, docs, tables)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = out.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted((r[:5] for r in ROWS), key=repr)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run(spark, tables):
    rows = C.run(spark, tables).collect()
    assert rows and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sum(r.text == " ".join(LONG) for r in rows) <= 3


def test_empty(spark, tables):
    none = spark.createDataFrame([], SCHEMA).drop("shard")
    for name, stage in C.STAGES:
        assert stage(spark, none, tables).count() == 0, name
    assert C.shard(spark, none, tables).select(F.col("slot")).count() == 0


def test_rows_that_differ_in_where_a_null_lies(spark):
    docs = spark.createDataFrame([(1, "t", "x", None), (1, "t", None, "x"), (1, "t", "x", None)], "doc_id long, text string, lang string, source string")
    assert C._tagged(docs).select(*C.SAME).distinct().count() == 2
