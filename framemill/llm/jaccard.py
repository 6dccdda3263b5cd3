"""N-gram Jaccard join over count vectors held in R-trees.

A document is the set of its distinct word n-grams ("shingles"), hashed to 64 bits. Hash ranges deal the shingles out
to groups; the group counts are the document's point. Two sets overlap in at most the sum of the coordinate minima of
their points, which bounds a pair, and a point against the box of an R-tree node, before any set is read. Ranges nest,
so a point folds to any coarser division: tree nodes are bounded on a coarse one, pairs on one with a group or two a
shingle, which few pairs that don't link pass.

A single tree over all points would be one task's work, so the tree's root is dealt out by key: linked sets share a
shingle among the first size - ceil(t * size) + 1 of each in any fixed order of all shingles. Those shingles are the
document's cells; documents that share a cell meet in a tree of that cell. The order is that of the hashes, with
shingles found in many different sets last, so that passages which many documents share form few cells. Which shingles
come last changes the work, never the links.

1. Equal sets are one node, whatever the ids of their rows.
2. Each member of a shared cell meets the cell's first member; pairs that pass the bound are verified on the sets.
   Verified links give provisional classes (this settles large groups of near copies with few pairs a member).
3. Cells that still hold several classes get an R-tree each, in blocks of bounded size. Of the pairs of different classes
   that the bounds don't rule out, those that would span a block are verified first, which merges dense groups with
   fewer pairs than members; then all pairs of classes that are still apart. All links together give the classes.

No link between different texts is lost: a pair that shares a cell is either in one class already or verified.

Trees hold points of one level of sizes (a power of two): a document also takes part in the level below if a linked
one can be there.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing; a text with fewer
words than n is one shingle; repeated rows are one node; rows that share an id but not the text are nodes of their own;
a null id takes part, but class ids are the smallest ids that are not null (null for a class without any); an empty table
gives no rows; extra columns are ignored, or kept if named in keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACES, U64, Scratch, mix, table, trimmed, words_of

#: A coarse group holds PER_GROUP to 2 * PER_GROUP shingles on average; 2 ** MAX_LEVEL coarse and 2 ** FINE fine groups at most.
PER_GROUP, MAX_LEVEL, FINE = 4, 10, 16
#: Shingles that are cells of over COMMON rows of different sets come last in the order, MAX_COMMON (0.8 MB) at most.
COMMON, MAX_COMMON = 32, 100_000
#: A node of over HOT pairs in one role is copied, one copy for HOT pairs, when pairs meet their sets.
BLOCK, FANOUT, SEEN, HOT = 512, 16, 1_000_000, 1_000
#: A list of ids up to this size (8 MB) is broadcast; a longer one is joined by shuffling.
BROADCAST_IDS = 1_000_000


# ------------------------------------------------------------------------------------------------- sets and points


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text (all its words, if fewer)."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, dtype=U64)
    for k in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(out))


class Threshold:
    """Similarity p / q."""

    def __init__(self, similarity: tuple[int, int]):
        self.p, self.q = similarity

    def need(self, a, b):
        """Least overlap of linked sets of sizes a and b."""
        return -((-self.p * (a + b)) // (self.p + self.q))

    def cells(self, size: int) -> int:
        """How many of its first shingles a set shares at least one of with any linked set."""
        return size + (-self.p * size // self.q) + 1

    def sizes(self, a: Column, b: Column) -> Column:
        """Whether sets of sizes a and b can link at all."""
        return F.least(a, b) * self.q >= F.greatest(a, b) * self.p

    def levels(self, n: Column) -> Column:
        """The own level, and the one below if a linked set can be there."""
        level = lambda size: F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.floor(F.log2(size / PER_GROUP + 1e-9)))).cast("int")
        return F.array_distinct(F.array(level(n), level(F.ceil(n * self.p / self.q))))


def level_of(size: int) -> int:
    return min(MAX_LEVEL, max(0, (size // PER_GROUP).bit_length() - 1))


def pack(sh: np.ndarray) -> bytes:
    """The point of a set, with as many groups as shingles or up to twice as many: a byte for the width, then the counts; small ones lie two to a byte, Huffman-coded, for most are 0 or 1."""
    level = min(FINE, (len(sh) - 1).bit_length())
    counts = np.bincount((sh >> U64(64 - level)).astype(np.int64) if level else np.zeros(len(sh), np.int64), minlength=1 << level)
    if level and counts.max() < 16:
        coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        return b"\0" + coder.compress((counts[::2] | counts[1::2] << 4).astype("u1").tobytes()) + coder.flush()
    return b"\4" + counts.astype("<u4").tobytes()


def unpack(data) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, dtype="<u4", offset=1).astype(np.int64)
    x = np.frombuffer(zlib.decompress(memoryview(data)[1:], -15), dtype="u1")
    out = np.empty(2 * len(x), dtype=np.int64)
    out[::2], out[1::2] = x & 15, x >> 4
    return out


def fold(p: np.ndarray, level: int) -> np.ndarray:
    """Counts of at most 2 ** level groups."""
    return p if len(p) <= 1 << level else p.reshape(1 << level, -1).sum(axis=1)


def most(p: np.ndarray, q: np.ndarray) -> int:
    """Greatest possible overlap: summed coordinate minima over the coarser of both divisions."""
    level = min(len(p), len(q)).bit_length() - 1
    return int(np.minimum(fold(p, level), fold(q, level)).sum())


KEY = ["n", "set_a", "set_b"]
OF_SET = "n long, set_a long, set_b long"


def _of_set(sh: np.ndarray) -> tuple[int, int, int]:
    """What tells a set from all others: its size and two sums of hashes."""
    return len(sh), int(sh.sum().view(np.int64)), int(mix(sh ^ U64(0xA24BAED4963EE407)).sum().view(np.int64))


def _cells(sh: np.ndarray, t: Threshold, last: np.ndarray) -> np.ndarray:
    first = t.cells(len(sh))
    if not len(last):
        return sh[:first]
    late = last[np.minimum(np.searchsorted(last, sh), len(last) - 1)] == sh
    return np.concatenate((sh[~late], sh[late]))[:first]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)], dtype=np.int32)), pa.array(flat))


def _counted(n: int, t: Threshold):
    """set_a and cells of each text."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for _, off, _, _, (h,), _ in words_of(b.column(b.num_columns - 1), SPACES):
                sets = [shingles(h[off[k] : off[k + 1]], n) for k in range(len(off) - 1)]
                sets = [sh for sh in sets if len(sh)]
                yield pa.RecordBatch.from_arrays([pa.array([_of_set(sh)[1] for sh in sets], pa.int64()), _lists([sh[: t.cells(len(sh))] for sh in sets])], ["set_a", "cells"])

    return run


def _features(n: int, t: Threshold, common: Broadcast, keep: list[str]):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]):
        last, none = common.value, np.zeros(0, dtype=U64)
        for b in batches:
            for lo, off, _, _, (h,), _ in words_of(b.column(len(keep)), SPACES):
                sets = [shingles(h[off[k] : off[k + 1]], n) for k in range(len(off) - 1)]
                keys = zip(*[_of_set(sh) if len(sh) else (0, 0, 0) for sh in sets])
                counts = pa.array([pack(sh) if len(sh) else b"" for sh in sets], pa.binary())
                cells = _lists([_cells(sh, t, last) if len(sh) else none for sh in sets])
                own = [b.column(i).slice(lo, len(sets)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(k, pa.int64()) for k in keys), counts, cells], [*keep, *KEY, "counts", "cells"])

    return run


# ------------------------------------------------------------------------------------------------------------ R-tree


class RTree:
    """Points packed into leaves of FANOUT by size and first coordinates, boxes of boxes above them."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.lexsort((points[:, 0], points.sum(axis=1)))
        low = high = points[self.order]
        self.levels = []
        while True:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low.sum(axis=1), high))
            if len(low) == 1:
                break

    def search(self, queries: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) for the tree's points numbered by queries and all points behind boxes that allow a link, all queries going down together."""
        sizes = self.points.sum(axis=1)
        q, nodes = queries, np.zeros(len(queries), dtype=np.int64)
        for least, high in reversed(self.levels):
            q, nodes = q[nodes < len(high)], nodes[nodes < len(high)]
            bound = np.minimum(high[nodes], self.points[q]).sum(axis=1)
            go = bound >= t.need(sizes[q], np.minimum(least[nodes], bound))
            q = np.repeat(q[go], FANOUT)
            nodes = (nodes[go][:, None] * FANOUT + np.arange(FANOUT)).ravel()
        q, nodes = q[nodes < len(self.points)], nodes[nodes < len(self.points)]
        return q, self.order[nodes]


def _allowed(points: np.ndarray, i: np.ndarray, j: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of points whose summed minima reach what a link needs."""
    sizes, step = points.sum(axis=1), max(1, (1 << 20) // points.shape[1])
    go = [np.minimum(points[i[k : k + step]], points[j[k : k + step]]).sum(axis=1) >= t.need(sizes[i[k : k + step]], sizes[j[k : k + step]]) for k in range(0, len(i), step)]
    go = np.concatenate(go) if go else np.zeros(0, dtype=bool)
    return i[go], j[go]


def _near(classes, side, points: list[np.ndarray], t: Threshold) -> Iterator[tuple[int, int]]:
    """Pairs i < j of different classes in one block that their points allow."""
    fine = min(map(len, points)).bit_length() - 1
    every = np.stack([fold(p, fine) for p in points]).astype(np.int32)
    n, tree = len(points), None
    if n > FANOUT:
        tree = RTree(np.stack([fold(p, level_of(int(every.sum(axis=1).max()))) for p in every]))
    for lo in range(0, n, 64):
        some = np.arange(lo, min(n, lo + 64))
        i, j = tree.search(some, t) if tree else (np.repeat(some, n), np.tile(np.arange(n), len(some)))
        go = (i < j) & (classes[i] != classes[j]) & ((side[i] != side[j]) | (side[i] == 0))
        i, j = i[go], j[go]
        if tree:
            i, j = _allowed(tree.points, i, j, t)
        i, j = _allowed(every, i, j, t)
        order = np.lexsort((j, i))
        yield from zip(i[order].tolist(), j[order].tolist())


def _tree_join(t: Threshold, spanning: bool):
    """Pairs that the points allow, the smaller node first, each once a task as far as SEEN pairs are remembered.

    spanning: only such as would join what no earlier pair of the block joins, so fewer than the block has members.
    """

    @trimmed
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            blocks = b.column(0)
            inner = blocks.flatten()
            ends = np.concatenate(([0], np.cumsum(blocks.value_lengths().to_numpy())))
            d, c, s = (inner.field(k).to_numpy() for k in range(3))
            vectors, pairs = inner.field(3), []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                order = np.argsort(d[lo:hi]) + lo
                ids, classes = d[order], c[order]
                points = [unpack(vectors[k].as_buffer()) for k in order.tolist()]
                joined = classes.copy()
                for i, j in _near(classes, s[order], points, t):
                    if spanning:
                        if joined[i] == joined[j]:
                            continue
                        joined[joined == joined[j]] = joined[i]
                    pair = int(ids[i]), int(ids[j])
                    if pair not in seen:
                        pairs.append(pair)
                        if len(seen) < SEEN:
                            seen.add(pair)
            left, right = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _bounded(t: Threshold):
    """Pairs whose points allow a link."""

    @trimmed
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = unpack(x.as_buffer()), unpack(y.as_buffer())
                keep.append(most(p, q) >= t.need(int(p.sum()), int(q.sum())))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(t: Threshold):
    @trimmed
    def run(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = []
            for i in range(b.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), dtype=U64) for c in (x, y))
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(common >= t.need(len(p), len(q)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(n: int):
    """The sets of texts, each with what tells it from others."""

    @trimmed
    def run(batches):
        for b in batches:
            for _, off, _, _, (h,), _ in words_of(b.column(0), SPACES):
                sets = [shingles(h[off[k] : off[k + 1]], n) for k in range(len(off) - 1)]
                sets = [sh for sh in sets if len(sh)]
                keys = list(zip(*map(_of_set, sets))) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array([sh.tobytes() for sh in sets], pa.binary())], [*KEY, "set"])

    return run


# ----------------------------------------------------------------------------------------------------------- classes


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class): the smallest node that links reach, by hooking to neighbours' labels and jumping."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("class").alias("m"))
        hooked = labels.join(near, labels.node == near.n).select("node", F.col("class").alias("old"), F.least("class", "m").alias("class"))
        up = labels.select(F.col("node").alias("u"), F.col("class").alias("up"))
        new = scratch.save(hooked.join(up, hooked["class"] == up.u, "left").select("node", "old", F.least("class", "up").alias("class")), "labels")
        changed = new.where(F.col("old") != F.col("class")).limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            return labels.select("node", "class")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (4, 5), keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id that links reach, the own id included), node (a number of the
    class, null without shingles) and the columns to keep.

    Documents link when q * intersection >= p * union, similarity being (p, q).
    """
    scratch, t, context = Scratch(docs.sparkSession), Threshold(similarity), docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    kept = narrow.columns[:-1]

    # shingles that are cells of many different sets
    cells = narrow.select("_text").mapInArrow(_counted(n, t), "set_a long, cells array<long>").select("set_a", F.explode("cells").alias("cell"))
    often = cells.groupBy("cell").agg(F.count("*").alias("m"), F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where((F.col("m") > COMMON) & (F.col("lo") != F.col("hi")))
    often = often.orderBy(F.desc("m"), "cell").limit(MAX_COMMON).select("cell").toPandas()["cell"]  # MAX_COMMON at most
    common = context.broadcast(np.sort(often.to_numpy(dtype=np.int64).view(U64)))

    schema = StructType([*narrow.schema.fields[:-1], *StructType.fromDDL(f"{OF_SET}, counts binary, cells array<long>").fields])
    rows = scratch.save(narrow.mapInArrow(_features(n, t, common, kept), schema), "features")
    own = rows.select("doc_id", *KEY, "counts", "cells").where("n > 0")
    sets = own.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    sets = scratch.save(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    # a set's point and cells come from a row with its smallest id
    named = sets.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("rep").alias("_rep"), "node")
    nodes = own.join(named, own["doc_id"].eqNullSafe(F.col("_rep")) & (own["n"] == F.col("_n")) & (own["set_a"] == F.col("_set_a")) & (own["set_b"] == F.col("_set_b")))
    nodes = scratch.save(nodes.dropDuplicates(["node"]).select("node", "n", "counts", "cells"), "nodes")
    cells = nodes.select("node", "n", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("end")).where("hub.node < end")
    members = scratch.save(cells.join(shared.select("cell", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "cell"), "members")
    vectors = nodes.select(F.col("node").alias("id"), F.col("counts").alias("v"))

    def met(pairs: DataFrame, table: DataFrame, side: str) -> DataFrame:
        """pairs with the columns of table (keyed by id) for their side; a side of many pairs meets several copies."""
        other = "b" if side == "a" else "a"
        often = pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count("*") / HOT).cast("int").alias("copies")).where("copies > 1")
        copies = table.join(often, "id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        dealt = pairs.join(often, pairs[side] == often.id, "left").drop("id").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        return dealt.join(copies.drop("copies"), (dealt[side] == copies.id) & (dealt["copy"] == copies["copy"])).drop("id", "copy")

    star = members.where((F.col("node") != F.col("hub")) & t.sizes(F.col("n"), F.col("hub_n")))
    star = scratch.save(star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    near = met(met(star, vectors.withColumnRenamed("v", "vb"), "b"), vectors.withColumnRenamed("v", "va"), "a")
    star = scratch.save(near.select("a", "b", "va", "vb").mapInArrow(_bounded(t), "a long, b long"), "near")

    def verify(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = scratch.save(sets.join(asked, "node", "left_semi").select("node", "rep", *KEY), "asked")
        small = asked.count() <= BROADCAST_IDS
        hint = F.broadcast if small else (lambda df: df)
        ids = asked.select(F.col("rep").alias("_rep")).distinct()
        texts = narrow.join(hint(ids), narrow["doc_id"].eqNullSafe(F.col("_rep")), "left_semi").select("_text")
        found = texts.mapInArrow(_sets(n), f"{OF_SET}, set binary").join(hint(asked.drop("rep")), KEY)
        found = scratch.save(found.dropDuplicates(["node"]).select(F.col("node").alias("id"), "set"), "found")
        both = met(met(pairs, found.withColumnRenamed("set", "sb"), "b"), found.withColumnRenamed("set", "sa"), "a")
        links = scratch.save(both.select("a", "b", "sa", "sb").mapInArrow(_verified(t), "a long, b long"), "links")
        scratch.drop(found, asked)
        return links

    def across(classes: DataFrame, spanning: bool) -> DataFrame:
        """Pairs of different classes that share a cell and that the points allow."""
        own = members.join(classes, F.col("node") == F.col("id"), "left").select("node", "cell", F.coalesce("class", "node").alias("class"), F.explode(t.levels(F.col("n"))).alias("level"))
        own = scratch.save(own, "own")
        mixed = own.groupBy("level", "cell").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("m")).where("lo != hi")
        chunks = F.ceil(F.col("m") / BLOCK).cast("int")
        part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        dealt = own.join(mixed, ["level", "cell"]).withColumn("chunks", chunks).withColumn("c", part)
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("level", "cell", "node", "class", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") == F.col("o"), 0).otherwise(F.col("c") + 1).alias("side"))
        blocks = dealt.groupBy("level", "cell", "i", "j").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("d"), F.col("class").alias("c"), F.col("side").alias("s")))).alias("m"))
        # many cells hold the same members: one block stands for all of them
        blocks = blocks.dropDuplicates(["m"]).withColumn("block", F.monotonically_increasing_id())
        blocks = scratch.save(blocks.select("block", "m"), "blocks")
        flat = blocks.select("block", F.explode("m").alias("x")).select("block", "x.d", "x.c", "x.s").join(vectors, F.col("d") == F.col("id"))
        flat = flat.groupBy("block").agg(F.collect_list(F.struct("d", "c", "s", "v")).alias("m"))
        pairs = scratch.save(flat.select("m").mapInArrow(_tree_join(t, spanning), "a long, b long").distinct(), "across")
        scratch.drop(own, blocks)
        return pairs

    def merged(links: DataFrame) -> DataFrame:
        return connected(links, scratch).withColumnRenamed("node", "id")

    links = verify(star)
    # what the first members left open: what joins most with few pairs, then whatever is still apart
    known = star
    for spanning in (True, False):
        pairs = across(merged(links), spanning).join(known, ["a", "b"], "left_anti")
        links = scratch.save(links.union(verify(pairs)), "links")
        known = known.union(pairs)
    classes = merged(links)

    named = sets.join(classes, F.col("node") == F.col("id"), "left").select(*KEY, "rep", "m", F.coalesce("class", "node").alias("node"))
    least = named.groupBy("node").agg(F.min("rep").alias("component_id"))
    named = scratch.save(named.join(least, "node").select(*KEY, "m", "node", "component_id"), "named")
    rows = rows.select(*kept, *KEY)
    out = [*kept, F.col("n").alias("n_shingles"), "component_id", "node"]
    none = rows.where("n = 0").withColumns({"component_id": F.col("doc_id"), "node": F.lit(None).cast("long")}).select(*out)
    some = rows.where("n > 0")
    hot = scratch.save(named.where(F.col("m") > HOT).drop("m"), "hot")  # sets with more than HOT rows
    if hot.isEmpty() or hot.count() > BROADCAST_IDS:
        return none.unionByName(some.join(named.drop("m"), KEY).select(*out))
    rest = some.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(named.where(F.col("m") <= HOT).drop("m"), KEY)
    return none.unionByName(some.join(F.broadcast(hot), KEY).select(*out)).unionByName(rest.select(*out))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), n=3, similarity=(9, 10)).select("doc_id", "n_shingles", "component_id")


#: Pairs by a join on shingles, classes by recursion; for small tables, as a shingle of m documents makes m * m / 2 rows.
OP2_SQL = rf"""
WITH RECURSIVE s AS (SELECT doc_id, list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w WHEN 2 THEN [w[1] || ' ' || w[2]] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g
  FROM (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents)),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS words FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS same FROM e a JOIN e b ON a.words = b.words AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * same >= 90 * (n - same)),
way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, way.b FROM reach JOIN way ON reach.other = way.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id"""


def brute_force(docs: list[tuple[int, str | None]], n: int, similarity: tuple[int, int]) -> list[tuple]:
    """The contract by comparing pairs through an inverted index, for tests."""
    p, q = similarity
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
    index, up = {}, {d: d for d in sets}

    def root(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    for d, s in sets.items():
        common = {}
        for x in s:
            for o in index.setdefault(x, []):
                common[o] = common.get(o, 0) + 1
            index[x].append(d)
        for o, k in common.items():
            if q * k >= p * (len(s) + len(sets[o]) - k):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return [(d, len(s), root(d)) for d, s in sets.items()]
