"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are encoded once (see tokens.py) and cut into full sequences and a rest. What the plan needs is the histogram
of piece lengths, at most SIZE rows whatever the number of documents. Lengths are placed longest first, each into the
shortest pack there is, or into new packs; the plan holds patterns with counts, never single packs. Where large gaps
stay, the emptiest packs are taken apart to fill them, which cuts pieces; what a last pack holds is split at powers of
two. A pattern asks for ranges of ranks of a length, so a piece finds its sequence by its rank among those of its length:
its place in its task plus the counts of the tasks before, which a window over (length, task) sums.

Pieces never meet by key: the counts are broadcast while there are at most BROADCAST_ROWS of them, and joined by
(task, length) beyond. The plan is broadcast; its size depends on SIZE and on the logarithm of the counts only.

Defined cases: a null text is empty and has the end id alone; rows with repeated or null ids each keep their pieces;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, trimmed
from .tokens import TOKENIZER, _encoder, _tokenizer_path, text_runs

SIZE, END_ID = 2048, 1
#: Gaps up to this many tokens stay as padding: at most 1 % of a sequence.
GAP = 16
BROADCAST_ROWS = 1_000_000
#: Pieces that a task turns at once.
ROWS = 256

#: (length, first rank, first token, tokens): one piece of each pack of a group, ranks ascending with the packs.
Piece = tuple[int, int, int, int]
#: (fill, count, pieces)
Group = tuple[int, int, list[Piece]]


# ---------------------------------------------------------------------------------------------------------------- plan


def _after(pieces: list[Piece], n: int) -> list[Piece]:
    """The pieces of a group's packs from the n-th on."""
    return [(length, rank + n, first, tokens) for length, rank, first, tokens in pieces]


def shortest_first(histogram: dict[int, int], size: int) -> list[Group]:
    """Groups of packs that hold every length of the histogram as often as it says."""
    heap: list[tuple[int, int, int, list[Piece]]] = []
    full: list[Group] = []
    tick = 0

    def add(fill: int, count: int, pieces: list[Piece]) -> None:
        nonlocal tick
        tick -= 1  # of equal fills the latest first
        if fill == size:
            full.append((fill, count, pieces))
        elif count:
            heapq.heappush(heap, (fill, tick, count, pieces))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if heap and heap[0][0] + length <= size:
                fill, _, count, pieces = heapq.heappop(heap)
                used = min(count, left)
                if used < count:
                    add(fill, count - used, _after(pieces, used))
                add(fill + length, used, [*pieces, (length, rank, 0, length)])
                rank, left = rank + used, left - used
            else:  # a new pack is the shortest until it is full
                times = size // length
                packs, rest = divmod(left, times)
                if packs:
                    add(times * length, packs, [(length, rank + k * packs, 0, length) for k in range(times)])
                if rest:
                    add(rest * length, 1, [(length, rank + packs * times + k, 0, length) for k in range(rest)])
                left = 0
    return full + [(fill, count, pieces) for fill, _, count, pieces in heap]


def _pour(give: Group, take: Group, size: int, gap: int) -> tuple[Group, Group]:
    """Both groups (of equal counts) after tokens went from the ends of the one to the other, until that one misses gap at most."""
    (fill, n, pieces), (filled, _, own) = give, take
    pieces, own = list(pieces), list(own)
    while pieces and size - filled > gap:
        length, rank, first, tokens = pieces.pop()
        moved = min(tokens, size - filled)
        own.append((length, rank, first + tokens - moved, moved))
        if tokens > moved:
            pieces.append((length, rank, first, tokens - moved))
        fill, filled = fill - moved, filled + moved
    return (fill, n, pieces), (filled, n, own)


def without_gaps(groups: list[Group], size: int, gap: int) -> list[Group]:
    """Packs that miss more than gap tokens are filled from others of the kind, which so become fewer.

    Half the packs of a group give to the other half, so a group is down to single packs in as many steps as its count
    has bits; of those left over, the emptiest give to the fullest.
    """
    done, single, work = [], [], list(groups)
    while work:
        fill, count, pieces = work.pop()
        if size - fill <= gap:
            done.append((fill, count, pieces))
        elif count == 1:
            single.append((fill, 1, pieces))
        elif fill:
            half = count // 2
            work += [(fill, count % 2, _after(pieces, 2 * half))] * (count % 2)
            work += _pour((fill, half, pieces), (fill, half, _after(pieces, half)), size, gap)
    open_ = deque(sorted((g for g in single if g[0]), key=lambda g: g[0]))
    while len(open_) > 1:
        give, take = _pour(open_.popleft(), open_.pop(), size, gap)
        (done if size - take[0] <= gap else open_).append(take)
        if give[0]:
            open_.appendleft(give)
    return done + [part for g in open_ for part in _powers(g)]


def _powers(group: Group) -> list[Group]:
    """One pack as packs whose sizes are powers of two, which need no padding."""
    fill, count, pieces = group
    out, rest = [], deque(pieces)
    for bit in reversed(range(fill.bit_length())):
        if fill >> bit & 1:
            room, own = 1 << bit, []
            while room:
                length, rank, first, tokens = rest.popleft()
                used = min(room, tokens)
                own.append((length, rank, first, used))
                if used < tokens:
                    rest.appendleft((length, rank, first + used, tokens - used))
                room -= used
            out.append((1 << bit, count, own))
    return out


class Plan:
    """Where pieces go, by length and rank, as sorted arrays."""

    def __init__(self, groups: list[Group]):
        rows, sequence = [], 0
        for _, count, pieces in groups:
            at = 0
            for length, rank, first, tokens in pieces:
                rows.append((length, rank, count, first, tokens, sequence - rank, at))
                at += tokens
            sequence += count
        slots = np.array(rows, dtype=np.int64).reshape(-1, 7)
        low = self.key(slots[:, 0], slots[:, 1])
        self.bounds = np.unique(np.concatenate((low, low + slots[:, 2])))
        a, b = np.searchsorted(self.bounds, low), np.searchsorted(self.bounds, low + slots[:, 2])
        of = np.repeat(np.arange(len(slots)), b - a)  # a slot for each stretch of ranks between bounds
        stretch = np.arange(len(of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[of]
        order = np.lexsort((slots[of, 3], stretch))
        self.slots, self.cuts = slots[of[order]], np.searchsorted(stretch[order], np.arange(len(self.bounds) + 1))

    @staticmethod
    def key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 50) + rank

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first token, tokens, sequence, offset), a row for each part of a piece."""
        at = np.searchsorted(self.bounds, self.key(length, rank), side="right") - 1
        n = self.cuts[at + 1] - self.cuts[at]
        row = np.repeat(np.arange(len(length)), n)
        slot = self.slots[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.cuts[at][row]]
        return row, slot[:, 3], slot[:, 4], slot[:, 5] + rank[row], slot[:, 6]


# ------------------------------------------------------------------------------------------------------------- pieces

PIECES = "task int, doc_id long, doc_tokens long, start long, length int, place long, width int, ids binary"


def encode_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of up to size ids of each document (doc_id, text) with the end id: place counts those of a length in a task."""

    @trimmed
    def run(batches):
        encoder, task, seen = _encoder(_tokenizer_path(tokenizer)), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        width = encoder.kind.itemsize
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for b in batches:
            for lo, rows in text_runs(b.column(1)):
                part = b.slice(lo, rows)
                raw = [e + end for e in encoder.encode(part.column(1))]
                total = np.array([len(r) // width for r in raw])
                n = -(-total // size)
                row = np.repeat(np.arange(len(raw)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[row] - start)
                place = np.empty(len(row), np.int64)
                for k, x in enumerate(length.tolist()):
                    place[k] = seen[x]
                    seen[x] += 1
                ids = [raw[r][a * width : (a + x) * width] for r, a, x in zip(row.tolist(), start.tolist(), length.tolist())]
                same = lambda v: pa.array(np.full(len(row), v, np.int32))
                yield pa.RecordBatch.from_arrays([same(task), part.column(0).take(pa.array(row)), pa.array(total[row]), pa.array(start), pa.array(length.astype(np.int32)), pa.array(place), same(width), pa.array(ids, pa.binary())], ["task", "doc_id", "doc_tokens", "start", "length", "place", "width", "ids"])

    return docs.mapInArrow(run, PIECES)


PLACED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Pieces with their count before, to PLACED; ids are little-endian unsigned 32-bit integers."""
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    @trimmed
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                doc, total, start, length, at, before, width, ids = b.slice(lo, ROWS).columns
                row, first, tokens, sequence, offset = shared.value.places(length.to_numpy().astype(np.int64), at.to_numpy() + before.to_numpy())
                raw = [np.frombuffer(i, dtype=f"<u{w}").astype("<u4") for i, w in zip(ids.to_pylist(), width.to_pylist())]
                own = [raw[r][a : a + n].tobytes() for r, a, n in zip(row.tolist(), first.tolist(), tokens.tolist())]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([doc.take(taken), pa.array(start.to_numpy()[row] + first), pa.array(tokens), pa.array(own, pa.binary()), total.take(taken), pa.array(sequence), pa.array(offset)], [f.split()[0] for f in PLACED.split(", ")])

    return pieces.select("doc_id", "doc_tokens", "start", "length", "place", "before", "width", "ids").mapInArrow(run, PLACED)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SIZE, end_id: int = END_ID, gap: int = GAP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per piece of a document: its ids and its place in a sequence."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = scratch.save(encode_pieces(rows, tokenizer, size, end_id), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.save(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    if not histogram:
        return docs.sparkSession.createDataFrame([], PLACED)
    before = counts.drop("n")
    before = F.broadcast(before) if before.count() <= broadcast_rows else before
    return place(pieces.join(before, ["task", "length"]), Plan(without_gaps(shortest_first(histogram, size), size, gap)))


def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
