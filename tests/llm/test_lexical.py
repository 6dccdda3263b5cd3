"""Treap search against plain loops: ties, repeated and null ids, blocks and slices of any size, empty tables."""

import random

import duckdb
import numpy as np
import pytest

from framemill.llm import lexical, queries

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(60)] + ["é𝄞", "LAS", "10"]
TEXTS = [None, "", " ,.- ", "one", "One, one", *["same words here"] * 14, *[" ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) for _ in range(300)], "w1 " * 5000 + "rare", "x" * 2_000_000]
DOCS = [(None if i % 41 == 7 else i // 2 if i % 19 == 3 else i, t) for i, t in enumerate(TEXTS)]
ITEMS = [(i, " ".join(rng.choices(WORDS, k=12))) for i in range(20)] + [(50, None), (51, "--"), (52, "absent"), (53, "SAME same Words"), (None, "rare w1"), (54, "one"), (54, "w2 w3")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, score int")
    return docs, spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, rank int")


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("parts,size,block", [(1, 1 << 22, 1 << 14), (5, 400, 7)])
def test_against_loops(tables, parts, size, block):
    docs, items = tables
    got = lexical.rank(docs.repartition(parts), items, slice_bytes=size, block_docs=block).collect()
    assert plain(tuple(r) for r in got) == plain(lexical.brute_force(DOCS, ITEMS))


@pytest.mark.parametrize("step,block", [(1, 1000), (3, 40), (1 << 13, 7)])
def test_walk(step, block):
    """Blocks one after another share the best; the walk leaves most documents out where impacts are skewed."""
    r = np.random.default_rng(block)
    n, terms = 1000, 8
    ids = r.permutation(n)
    row, term = np.nonzero(r.random((n, terms)) < 0.3)
    impact = np.maximum(1, (r.pareto(0.7, len(row)) * 10).astype(np.int64)) // 3 + 1
    items = [[0, 1, 2], [3], [4, 5, 6, 7], []]
    best, scored = lexical.Best(len(items), 5), 0
    for lo in range(0, n, block):
        on = (row >= lo) & (row < lo + block)
        t = lexical.Treaps(ids[lo : lo + block], np.zeros(len(ids[lo : lo + block]), bool), row[on] - lo, term[on], impact[on])
        scored += lexical.search(t, items, best, step)
    for q, own in enumerate(items):
        total = np.zeros(n, np.int64)
        mine = np.isin(term, own)
        np.add.at(total, row[mine], impact[mine])
        want = sorted(((-s, i) for s, i in zip(total.tolist(), ids.tolist()) if s))[:5]
        on = best.item == q
        assert list(zip((-best.score[on]).tolist(), best.id[on].tolist())) == want
    assert scored < 2000 * 0.8


def test_treap_order():
    r = np.random.default_rng(1)
    row, term = np.nonzero(r.random((200, 3)) < 0.5)
    t = lexical.Treaps(np.arange(200), np.zeros(200, bool), row, term, r.integers(1, 5, len(row)))
    for i in range(len(t.doc)):
        for child, side in ((t.left[i], -1), (t.right[i], 1)):
            if child >= 0:
                assert t.impact[child] <= t.impact[i] and (t.doc[child] - t.doc[i]) * side > 0
    assert sorted(t.root) == [0, 1, 2]


def test_empty(spark, tables):
    docs, items = tables
    assert lexical.rank(docs.where("false"), items).collect() == []
    assert lexical.rank(docs, items.where("false")).collect() == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.SQL["op12_inverted_treaps"]).fetchall()
    got = queries.QUERIES["op12_inverted_treaps"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert plain(map(tuple, got)) == plain(want) and len(want) > 100
