"""Registered queries on small tables: every column of their contracts against plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from framemill.llm import pii, queries, toxicity

TEXTS = [None, "", "é𝄞", *["copied words here"] * 5, *[f"clean words of page {i} and river {i % 5}" for i in range(60)], *[f"vile scum of page {i} and river {i % 5}" for i in range(60)], "mail a.b@c.example.org or 1.2.3.4"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{base}/documents.parquet")
    labels = [(i, int("vile" in t)) for i, t, _ in rows if t]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_op4(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op4_label_propagation_shards"](spark, folder).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    count = Counter(r.shard for r in got.values())
    sizes = [count[s] for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(TEXTS)
    assert {(r.shard, r.slot) for r in got.values()} == {(s, k) for s in range(40) for k in range(sizes[s])}
    again = {r.doc_id: r for r in queries.QUERIES["op4_label_propagation_shards"](spark, folder).collect()}
    assert again == got


def test_op8(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op8_toxicity"](spark, folder).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.REJECT)
    held = [i for i, r in got.items() if r.held_out and TEXTS[i] and "page" in TEXTS[i]]
    toxic, clean = ([got[i].score for i in held if ("vile" in TEXTS[i]) == kind] for kind in (True, False))
    assert toxic and clean and min(toxic) > max(clean)
    assert got[0].score == got[1].score  # null counts as empty


def test_op6(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op6_context_pii"](spark, folder).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        want = pii.brute_force_base(t)
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(spans.split(",")) - {""} <= set(got[i].spans.split(","))
