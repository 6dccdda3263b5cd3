"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the test items: every run of WINDOW consecutive words, or a shorter item as one window.
A shift table by two-word block says how far the search may jump, a suffix-hash bucket names the windows that can
end at a position, and a comparison of the words themselves confirms an occurrence.

Test suites have a checked size: windows are handed to tasks in slices of at most SLICE_BYTES of item text (a longer
item is a slice of its own), one slice after the other, so the driver holds one at a time; more slices mean more passes,
never fewer windows. Documents are never shuffled in a single pass; with more passes rows meet by a saved row number.

Defined cases: null and empty texts have no words, no hits and are never contaminated; items without words have no
windows; equal items are reported each under its own id; an item whose item_id is null hits but is left out of the list;
repeated rows of a document each get their row, whatever their ids; extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NON_WORD, Scratch, table, trimmed, words_of

WINDOW = 13
SLICE_BYTES = 16 << 20


class WuManber:
    """Windows of one length; words are 64-bit hashes, checked against the words' bytes at the end."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], hashes: dict[bytes, int], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[object, int] = {}
        self.buckets = defaultdict(list)
        for words, items in windows.items():
            ids = [hashes[w] for w in words]
            for end in range(self.block, length + 1):
                key = self.key(ids, end - 1)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[self.key(ids, length - 1)].append((ids, words, items))

    def key(self, ids: list[int], last: int) -> object:
        return (ids[last - 1], ids[last]) if self.block == 2 else ids[last]

    def search(self, ids: list[int], word) -> Iterator[tuple[int, set[str]]]:
        """Start word and items of each occurrence; word(i) gives the bytes of the i-th word."""
        at, n, m, shift, two, default = self.length - 1, len(ids), self.length, self.shift, self.block == 2, self.default
        while at < n:
            jump = shift.get((ids[at - 1], ids[at]) if two else ids[at], default)
            if jump:
                at += jump
                continue
            first = at - m + 1
            for want, words, items in self.buckets[self.key(ids, at)]:
                if ids[first : at + 1] == want and all(word(first + k) == w for k, w in enumerate(words)):
                    yield first, items
            at += 1


def compile_items(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    hashes: dict[bytes, int] = {}
    for item, text in items:
        for _, offsets, s, e, (h,), buf in words_of(pa.array([text]), NON_WORD):
            raw = buf.tobytes().lower()
            words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            hashes.update(zip(words, h.tolist()))
            m = min(window, len(words))
            for k in range(len(words) - m + 1 if m else 0):
                by_length[m][tuple(words[k : k + m])].update([] if item is None else [item])
    return [WuManber(w, hashes, m) for m, w in sorted(by_length.items())]


def hits_of(searchers: list[WuManber], ids: list[int], word) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint hit word ranges (end exclusive) and the items of a document."""
    found, items = [], set()
    for s in searchers:
        for first, its in s.search(ids, word):
            found.append((first, first + s.length))
            items |= its
    return disjoint(found), items


def disjoint(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


def _slices(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in groups of a bounded size, streamed partition by partition."""
    group, size = [], 0
    for i, t in items.toLocalIterator():
        more = len(t.encode())
        if group and size + more > limit:
            yield group
            group, size = [], 0
        group.append((i, t))
        size += more
    if group:
        yield group


RESULT = "n_words long, n_hit long, n_items long, items array<string>, ranges array<long>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id (or the columns to keep), n_words, n_hit, n_items, items (sorted ids), ranges (flat, disjoint hit word ranges, end exclusive)."""
    spark = docs.sparkSession
    rows = docs.select(*(keep or [F.col(id_col).cast("long").alias("doc_id")]), *[F.col(text_col).alias("_text")] * (text_col not in keep))
    own = list(keep or ["doc_id"])
    text = text_col if text_col in keep else "_text"
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    slices = -(-(items.agg(F.sum(F.octet_length("t"))).head()[0] or 0) // slice_bytes)

    def scan(df: DataFrame, own: list[str], searchers, hit_only: bool = False) -> DataFrame:
        """The columns own of df (which has the text as well) and what the searchers find."""
        df = df.select(*own, *[text] * (text not in own))
        at = df.columns.index(text)

        @trimmed
        def run(batches):
            for b in batches:
                found = _scan_texts(b.column(at), searchers.value)
                out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), *found.columns], [*own, *found.schema.names])
                yield out.filter(pc.greater(out.column("n_hit"), 0)) if hit_only else out

        return df.mapInArrow(run, _schema(df, own, RESULT))

    if slices <= 1:
        group = [(i, t) for i, t in items.collect()]
        return scan(rows, own, spark.sparkContext.broadcast(compile_items(group, window)))
    # several slices: a pass each, of which only the first writes rows without hits; what belongs to a row meets by its number
    scratch = Scratch(spark)
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    passes = []
    for group in _slices(items.repartition(slices), slice_bytes):
        searchers = spark.sparkContext.broadcast(compile_items(group, window))
        passes.append(scratch.save(scan(rows, ["_row"], searchers, hit_only=bool(passes)), "hits"))
        searchers.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("ranges")).alias("ranges"))
    merged = merged.mapInArrow(_merge_batches, f"_row long, {RESULT}")
    return rows.select("_row", *own).join(merged, "_row").drop("_row")


def _schema(df: DataFrame, own: list[str], more: str) -> StructType:
    return StructType([*(df.schema[c] for c in own), *StructType.fromDDL(more)])


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, n_words, items, ranges of all passes to _row and RESULT."""
    for b in batches:
        ranges = [disjoint(list(zip(r[::2], r[1::2]))) for r in b.column(3).to_pylist()]
        found = _result(b.column(1).to_pylist(), ranges, b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), *found.columns], ["_row", *found.schema.names])


def _result(n_words: list[int], ranges: list[list[tuple[int, int]]], items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [sum(b - a for a, b in r) for r in ranges]
    flat = [[x for ab in r for x in ab] for r in ranges]
    return pa.RecordBatch.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(flat, pa.list_(pa.int64()))], ["n_words", "n_hit", "n_items", "items", "ranges"])


def _scan_texts(texts: pa.Array, searchers: list[WuManber]) -> pa.RecordBatch:
    n_words, items, ranges = [], [], []
    for _, offsets, s, e, (h,), buf in words_of(texts, NON_WORD):
        for k in range(len(offsets) - 1):
            lo, hi = int(offsets[k]), int(offsets[k + 1])

            def word(i: int, lo=lo) -> bytes:
                return buf[s[lo + i] : e[lo + i]].tobytes().lower()

            found, its = hits_of(searchers, h[lo:hi].tolist(), word) if hi > lo else ([], set())
            n_words.append(hi - lo)
            items.append(sorted(its))
            ranges.append(found)
    return _result(n_words, ranges, items)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


#: Windows as strings, joined with the runs of each window length in the documents.
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT *, least({WINDOW}, len(w)) AS m FROM (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS words FROM p),
runs AS (SELECT doc_id, m, list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' ')) AS r FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
found AS (SELECT doc_id, a.m, k, item_id FROM (SELECT doc_id, m, unnest(r) AS words, generate_subscripts(r, 1) AS k FROM runs) a JOIN win ON a.m = win.m AND a.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS h FROM (SELECT DISTINCT doc_id, m, k FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for tests."""
    import re

    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            p = words(text)
            m = min(window, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    names |= set() if item is None else {str(item)}
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
