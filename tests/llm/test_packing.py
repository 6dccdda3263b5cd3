"""Packing: plans of any histogram hold every token once, sequences are gapless, and pieces give back their documents' ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import packing, queries, tokens

TEXTS = [None, "", "", "a", "some words here", *["the same text"] * 30, "word " * 5000, "x1 " * 2047, *[" ".join(random.Random(i).choices("river stone light 12 é𝄞 , .".split(), k=i * 7 % 900)) for i in range(80)]]
ROWS = [(None if i == 3 else 5 if i in (8, 9) else i, t, "x") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens._tokenizer_path(tokens.TOKENIZER))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x, _ in ROWS]


def check(groups, histogram, size, gap):
    """Every token of every rank exactly once, packs within size, padding within the gap but for powers of two."""
    seen = defaultdict(list)
    for fill, count, pieces in groups:
        assert sum(p[3] for p in pieces) == fill <= size and count > 0
        assert size - fill <= gap or fill & (fill - 1) == 0
        for length, rank, first, n in pieces:
            assert n > 0
            for k in range(count):
                seen[length, rank + k].append((first, n))
    assert {k: sum(r[0] == k for r in seen) for k in histogram} == histogram
    for (length, _), parts in seen.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == length


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from([0, 2, 8]))
def test_plans(histogram, gap):
    groups = packing.without_gaps(packing.shortest_first(histogram, 64), 64, gap)
    check(groups, histogram, 64, gap)
    if not groups:
        return
    plan = packing.Plan(groups)
    length, rank = (np.array(x, dtype=np.int64) for x in zip(*[(k, r) for k, n in histogram.items() for r in range(n)]))
    row, first, n, sequence, offset = plan.places(length, rank)
    by = defaultdict(list)
    for s, o, k in zip(sequence.tolist(), offset.tolist(), n.tolist()):
        by[s].append((o, k))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
    assert n.sum() == length.sum()


def test_shortest_pack_takes_the_next_length():
    groups = packing.shortest_first({60: 1, 50: 1, 10: 2, 4: 1}, 64)
    assert sorted(sorted(p[0] for p in g[2]) for g in groups) == [[4, 10], [10, 50], [60]]


def test_large_counts_stay_small():
    groups = packing.without_gaps(packing.shortest_first({1500: 10**12, 1100: 10**11 + 7, 3: 5}, 2048), 2048, 16)
    assert sum(len(g[2]) for g in groups) < 5000
    used = sum(g[0] * g[1] for g in groups)
    assert used == 1500 * 10**12 + 1100 * (10**11 + 7) + 15
    assert sum(2048 * g[1] for g in groups if g[0] & (g[0] - 1)) <= used * 1.01


@pytest.mark.parametrize("parts,rows", [(1, 10**6), (6, 10**6), (6, 0)])
def test_pieces(spark, plain, parts, rows):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, sequence_id string").repartition(parts)
    got = packing.pack(docs, broadcast_rows=rows).collect()
    found = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        found[r.doc_id].append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    want = defaultdict(list)
    for (i, _, _), ids in zip(ROWS, plain):
        want[i].append(ids)
    assert set(found) == set(want)
    for i, texts in want.items():
        if len(texts) == 1:
            ordered = sorted(found[i])
            assert [x for p in ordered for x in p[2]] == texts[0] and {p[1] for p in ordered} == {len(texts[0])}
        assert sum(len(p[2]) for p in found[i]) == sum(map(len, texts))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for p in by.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, plain))


def test_query(spark, tmp_path, plain):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_histogram_packing"](spark, str(tmp_path)).collect()
    ids = {i: p for (i, _, _), p in zip(ROWS, plain) if i not in (5, None)}
    for r in got:
        if r.doc_id in ids:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
