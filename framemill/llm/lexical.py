"""Ranked lexical search over inverted treaps.

Documents are scanned once a slice of test items: each leaves its term count and the counts of the terms that items ask
for. A task takes its documents in blocks, numbered in doc_id order; every term's postings of a block form a treap:
doc_id search order, impact heap order. An item walks its terms' treaps together over intervals of documents: the
roots' impacts sum to a bound, an interval whose bound can't enter the item's best k goes with all below it, and else the
document of the largest root is scored in full and splits the interval. Intervals of many items are walked side by side,
those with the highest bounds first. Blocks of a task share the items' best k, so a task hands on k rows an item at most,
and these are merged by item. No posting is shuffled, and a common term is spread like the documents.

Terms are compared by 64-bit hashes. Items are handed to tasks in slices of at most SLICE_BYTES of text (a longer item is
a slice of its own); more slices mean more passes, never fewer items.

Defined cases: null texts, and texts without a term, match nothing and don't count; an item without terms has no rows;
equal scores rank by ascending doc_id, null ids last; repeated doc_ids each take a place; items that share an id, or have
none, are ranked each on its own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_WORD, Scratch, table, trimmed, words_of

TOP, SLICE_BYTES = 10, 4 << 20
#: Documents and postings of a block, and intervals walked at once: they bound a task's memory.
BLOCK_DOCS, BLOCK_POSTINGS, STEP = 1 << 14, 1 << 20, 1 << 13
NO_ID = np.iinfo(np.int64).max


# ----------------------------------------------------------------------------------------------------------- postings


def terms_of(texts: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """By runs of rows: terms of each row, and (row, place in the sorted vocabulary, count) of those in it."""
    for _, offsets, _, _, (h,), _ in words_of(texts, NON_WORD):
        n = np.diff(offsets)
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        known = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(n)), n)[known]
        key, count = np.unique(row * max(1, len(vocabulary)) + at[known], return_counts=True)
        yield n.tolist(), key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), count


COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"


def count_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row per document (doc_id, text) with terms: doc_id, n, and the terms in the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @trimmed
    def run(batches):
        for b in batches:
            at = 0
            for n, row, term, count in terms_of(b.column(1), shared.value):
                cuts = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (term, count)]
                out = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(np.array(n) > 0))
                at += len(n)

    return docs.mapInArrow(run, COUNTED)


# -------------------------------------------------------------------------------------------------------------- treaps


class Treaps:
    """Treaps of all terms over one block of documents; a node is a posting."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray):
        """ids, missing (whether null) of the documents; row, term, impact of the postings."""
        order = np.lexsort((ids, missing))
        self.ids, self.missing = ids[order], missing[order]
        number = np.empty(len(ids), dtype=np.int64)
        number[order] = np.arange(len(ids))
        doc = number[row]
        by = np.lexsort((doc, term))
        self.doc, term, self.impact = doc[by], term[by], impact[by]
        self.key = term * len(ids) + self.doc
        self.docs = len(ids)
        self._grow(term)

    def _grow(self, term: np.ndarray) -> None:
        """Children by one pass from left to right along the right edge; equal impacts fall in a pseudo-random order."""
        n = len(self.doc)
        shaken = ((self.impact << 20) | ((self.doc * 0x9E3779B1 >> 7) & 0xFFFFF)).tolist()
        left, right, edge, root, last = [-1] * n, [-1] * n, [], {}, None
        for i, (t, v) in enumerate(zip(term.tolist(), shaken)):
            if t != last:
                edge, last = [], t
            below = -1
            while edge and shaken[edge[-1]] < v:
                below = edge.pop()
            left[i] = below
            if edge:
                right[edge[-1]] = i
            else:
                root[t] = i
            edge.append(i)
        self.left, self.right, self.root = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), root

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each node's treap the highest node with lo <= doc <= hi; -1 if there is none."""
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            low, high = self.doc[at] < lo[live], self.doc[at] > hi[live]
            out = low | high
            live, at, low = live[out], at[out], low[out]
            node[live] = np.where(low, self.right[at], self.left[at])
            live = live[node[live] >= 0]
        return node

    def impact_at(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of each node's term in a document; 0 where it does not occur."""
        key = self.key[node] - self.doc[node] + doc
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0)


class Best:
    """The k best (score, id) of each item, better ones first."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item = np.zeros(0, np.int64)
        self.score, self.id, self.missing = self.item, self.item, np.zeros(0, bool)
        self._limits()

    def _limits(self) -> None:
        """What a document must beat: the item's k-th score and, for ties, its id."""
        self.least, self.last, self.none = np.zeros(self.items, np.int64), np.full(self.items, NO_ID), np.ones(self.items, bool)
        ends = np.flatnonzero(np.append(self.item[1:] != self.item[:-1], True)) if len(self.item) else np.zeros(0, np.int64)
        starts = np.append(0, ends[:-1] + 1)
        full = ends[ends - starts[: len(ends)] + 1 == self.k]
        at = self.item[full]
        self.least[at], self.last[at], self.none[at] = self.score[full], self.id[full], self.missing[full]
        self.open = np.ones(self.items, bool)
        self.open[at] = False

    def can_enter(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Whether a score at this id, or a later one, could rank among the item's best."""
        before = (missing < self.none[item]) | ((missing == self.none[item]) & (id_ < self.last[item]))
        return (score > 0) & (self.open[item] | (score > self.least[item]) | ((score == self.least[item]) & before))

    def add(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray, missing: np.ndarray) -> None:
        fits = self.can_enter(item, score, id_, missing)
        if not fits.any():
            return
        item, score, id_, missing = (np.concatenate((old, new[fits])) for old, new in ((self.item, item), (self.score, score), (self.id, id_), (self.missing, missing)))
        order = np.lexsort((id_, missing, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.item, self.score, self.id, self.missing = item[place < self.k], score[keep], id_[keep], missing[keep]
        self._limits()


def search(t: Treaps, items: list[list[int]], best: Best, step: int = STEP) -> int:
    """Walk the items' terms through the treaps of a block; the number of documents scored.

    A front is intervals (item, lo, hi) with their nodes behind one another; the fronts waiting lie on a stack, so that
    memory is bounded by the walk's depth, not by its breadth.
    """
    starts = [(q, nodes) for q, terms in enumerate(items) if (nodes := [t.root[x] for x in terms if x in t.root])]
    if not starts:
        return 0
    sizes = np.array([len(n) for _, n in starts])
    item = np.array([q for q, _ in starts])
    stack = [(item, np.zeros(len(item), np.int64), np.full(len(item), t.docs - 1), sizes, np.concatenate([n for _, n in starts]))]
    scored = 0
    while stack:
        item, lo, hi, sizes, nodes = stack.pop()
        first = np.cumsum(sizes) - sizes
        impact = t.impact[nodes]
        bound = np.add.reduceat(impact, first)
        live = best.can_enter(item, bound, t.ids[lo], t.missing[lo])
        if live.sum() > step:  # the most promising first
            order = np.argsort(np.where(live, -bound, 1), kind="stable")
            front, later = np.zeros(len(item), bool), np.zeros(len(item), bool)
            front[order[:step]] = True
            later[order[step : int(live.sum())]] = True
            stack.append((item[later], lo[later], hi[later], sizes[later], nodes[np.repeat(later, sizes)]))
            live = front
        if not live.any():
            continue
        nodes, item, lo, hi, sizes = nodes[np.repeat(live, sizes)], item[live], lo[live], hi[live], sizes[live]
        owner, first = np.repeat(np.arange(len(item)), sizes), np.cumsum(sizes) - sizes
        impact, doc = t.impact[nodes], t.doc[nodes]
        most = np.maximum.reduceat(impact, first)
        # the document of a largest root, the lowest of equals
        split = np.minimum.reduceat(np.where(impact == most[owner], doc, t.docs), first)
        best.add(item, np.add.reduceat(t.impact_at(nodes, split[owner]), first), t.ids[split], t.missing[split])
        scored += len(item)
        sides = [(lo, split - 1, nodes), (split + 1, hi, nodes)]
        parts = []
        for a, b, own in sides:
            wide = a <= b
            inner = np.where(wide[owner], own, -1)
            inner = t.within(inner, a[owner], b[owner])
            on = inner >= 0
            count = np.bincount(owner[on], minlength=len(item))
            some = count > 0
            parts.append((item[some], a[some], b[some], count[some], inner[on]))
        both = [np.concatenate(x) for x in zip(*parts)]
        if len(both[0]):
            stack.append(tuple(both))
    return scored


# -------------------------------------------------------------------------------------------------------------- ranking


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], dtype=np.int64)


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, exact beyond 64 bits as well."""
    if 90 * n_docs * int(n.max(initial=0)) < 1 << 63:
        return 10 + 90 * n * n_docs // max(1, n_terms)
    return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(ids, missing, n, row, term, count) of documents up to a block's bounds."""
    parts, docs, postings = [], 0, 0
    for b in batches:
        for lo in range(0, b.num_rows, min(1024, most)):
            c = b.slice(lo, min(1024, most))
            lists = [c.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3)]
            row = np.repeat(np.arange(c.num_rows), c.column(2).value_lengths().to_numpy()) + docs
            missing = c.column(0).is_null().to_numpy(zero_copy_only=False)
            parts.append((c.column(0).fill_null(NO_ID).to_numpy(), missing, c.column(1).to_numpy(), row, *lists))
            docs, postings = docs + c.num_rows, postings + len(row)
            if docs >= most or postings >= BLOCK_POSTINGS:
                yield tuple(np.concatenate(x) for x in zip(*parts))
                parts, docs, postings = [], 0, 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _slices(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """(row, item id, text) in groups of a bounded size, streamed to the driver."""
    group, size = [], 0
    for r in items.toLocalIterator():
        if group and size + len(r.text.encode()) > limit:
            yield group
            group, size = [], 0
        group.append(tuple(r))
        size += len(r.text.encode())
    if group:
        yield group


def rank(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = TOP, slice_bytes: int = SLICE_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    items = queries.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    kind = queries.schema[item_col].dataType
    found, totals = [], None
    for group in _slices(items, slice_bytes):
        asked = [np.unique(np.concatenate([h for *_, (h,), _ in words_of(pa.array([text]), NON_WORD)])) for *_, text in group]
        vocabulary = np.unique(np.concatenate(asked))
        counted = scratch.save(count_terms(rows, vocabulary), "counted")
        totals = totals or counted.agg(F.count("*"), F.sum("n")).head()
        n_docs, n_terms = totals[0], totals[1] or 0
        df = np.zeros(len(vocabulary), np.int64)  # a row a term of the slice
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r[0]] = r[1]
        shared = spark.sparkContext.broadcast((weights_of(n_docs, df), [np.searchsorted(vocabulary, a).tolist() for a in asked]))
        out = counted.where(F.size("terms") > 0).mapInArrow(_searched(shared, n_docs, n_terms, k, block_docs), "place int, doc_id long, score long")
        names = spark.createDataFrame([(p, row, item) for p, (row, item, _) in enumerate(group)], f"place int, row long, item_id {kind.simpleString()}")
        found.append((out, names))
    out = None
    for hits, names in found:
        best = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        part = top.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")  # names: a row an item of a slice
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


def _searched(shared, n_docs: int, n_terms: int, k: int, block_docs: int):
    @trimmed
    def run(batches):
        weights, items = shared.value
        best = Best(len(items), k)
        for ids, missing, n, row, term, count in _blocks(batches, block_docs):
            impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * norms(n, n_docs, n_terms)[row]))
            useful = impact > 0
            search(Treaps(ids, missing, row[useful], term[useful], impact[useful]), items, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.id, mask=best.missing), pa.array(best.score)], ["place", "doc_id", "score"])

    return run


def op12_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT row_number() OVER () AS r, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM c),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS w FROM c) WHERE w IN (SELECT w FROM q) GROUP BY r, w),
i AS (SELECT w, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY w, s.docs),
v AS (SELECT p.r, p.w, i.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * c.n * s.docs) // s.terms))) AS impact FROM p JOIN i USING (w) JOIN c USING (r), s),
g AS (SELECT q.item_id, v.r, sum(v.impact)::BIGINT AS score FROM q JOIN v USING (w) GROUP BY q.item_id, v.r),
o AS (SELECT g.item_id, c.doc_id, g.score, row_number() OVER (PARTITION BY g.item_id ORDER BY g.score DESC, c.doc_id) AS rank FROM g JOIN c USING (r) WHERE g.score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {TOP}"""


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], k: int = TOP) -> list[tuple]:
    """The contract by plain loops, for tests."""
    import re
    from collections import Counter

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())
    counts = [(d, Counter(w)) for d, t in docs if (w := words(t))]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            scores += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out
