"""Shared pieces of the training-data operators: shared scratch tables, vectorised word hashing, distributed prefix sums."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that the vectorised word hash handles at once; its temporaries take about 40 times as much.
CHUNK = 1 << 19


def trimmed(f):
    """f over a task's batches; what it leaves unused in the worker's memory pools goes back to the system at its end."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


def small_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Hand whole texts to Python workers by batches of about this size: an executor holds each batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that the cluster names in spark.checkpoint.dir (one's own only where that is unset).

    They cut lineage and are read by any executor, so a lost executor costs only its running tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.saved = spark, {}, 0
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.saved += 1
        path = f"{self.base}/{name}-{self.saved}"
        df.write.parquet(path)
        gc.collect()
        self.spark._jvm.System.gc()  # what the finished job shuffled can go now, not only when the driver's heap is full
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            _, path = self.paths.pop(id(t))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


# ---------------------------------------------------------------------------------------------------------- words

U64 = np.uint64
_MUL, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators by byte: ASCII white space; everything but digits, letters and non-ASCII bytes.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
NON_WORD = np.arange(256) < 128
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MUL))[LOWER]  # upper and lower case letters share a value
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 4096)
        for k, m in enumerate((_MUL, _INV)):
            t = np.full(n, m, dtype=U64)
            t[0] = 1
            t = np.multiply.accumulate(t)
            _powers[k : k + 1] = [t]
    return _powers


def _hash_piece(buf: np.ndarray, starts_here: np.ndarray, seps: np.ndarray, prefixes: tuple[int, ...]):
    """Word starts, ends and hashes of one buffer; starts_here marks bytes where a new text begins."""
    n = len(buf)
    word = ~seps[buf]
    first = word.copy()
    first[1:] &= ~word[:-1] | starts_here[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | starts_here[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    c = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * up[:n], out=c[1:])
    hashes = [mix((c[e] - c[s]) * down[s] + (e - s).astype(U64))]
    for k in prefixes:
        m = np.minimum(s + k, e)
        hashes.append(mix((c[m] - c[s]) * down[s] + U64(k << 32)))
    return s, e, hashes


def words_of(texts: pa.Array, seps: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(first row, word offsets by row, start bytes, end bytes, hashes, bytes) for runs of rows.

    Hashes cover the lower-cased (A-Z) bytes of each word; prefixes adds arrays that hash the words' first bytes only.
    A run has about CHUNK bytes; a longer text is a run of its own, hashed piece by piece between separators, so the
    temporaries stay bounded whatever a text's length. Nulls count as empty.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1)
        buf = data[off[row] : off[end]]
        cuts = off[row : end + 1] - off[row]
        parts = []
        at = 0
        while at < len(buf):
            to = min(at + CHUNK, len(buf))
            if to < len(buf):  # a long text: cut at its last separator, or look further for one
                back = np.flatnonzero(seps[buf[at:to]])
                while not len(back) and to < len(buf):
                    to = min(to + CHUNK, len(buf))
                    back = np.flatnonzero(seps[buf[at:to]])
                if to < len(buf):
                    to = at + int(back[-1]) + 1
            begin = np.zeros(to - at, dtype=bool)
            inner = cuts[(cuts >= at) & (cuts < to)] - at
            begin[inner] = True
            s, e, hs = _hash_piece(buf[at:to], begin, seps, prefixes)
            parts.append((s + at, e + at, hs))
            at = to
        if parts:
            s, e = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            hs = [np.concatenate([p[2][k] for p in parts]) for k in range(1 + len(prefixes))]
        else:
            s = e = np.zeros(0, dtype=np.int64)
            hs = [np.zeros(0, dtype=U64)] * (1 + len(prefixes))
        yield row, np.searchsorted(s, cuts), s, e, hs, buf
        row = end


# ---------------------------------------------------------------------------------------- distributed prefix sums


def order_hash(*cols: str) -> Column:
    """A hexadecimal string that puts rows in a fixed pseudo-random order."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]))


def running_sum(df: DataFrame, keys: list[str], first: list[Column], order: str, value: str, out: str, ties: list[str] = ()) -> DataFrame:
    """Exclusive running sum of value within keys, ordered by (first, order, ties), with no group in one task.

    order holds hexadecimal hashes: their first three digits deal each key out to 4096 buckets. Totals by
    bucket (a bounded number a key) are summed by a window over that small table, rows by one within a bucket.
    """
    rows = df.withColumns({f"__f{i}": c for i, c in enumerate(first)}).withColumn("__bucket", F.substring(order, 1, 3))
    by = [*keys, *(f"__f{i}" for i in range(len(first))), "__bucket"]
    totals = rows.groupBy(*by).agg(F.sum(value).alias("__total"))
    w = Window.partitionBy(*keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__total").over(w), F.lit(0)).alias("__before"))
    on = [F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(by)]
    inner = Window.partitionBy(*by).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return rows.withColumn("__own", own).join(totals, on).withColumn(out, F.col("__before") + F.col("__own")).drop(*[c for c in by if c not in keys], *[f"__t{i}" for i in range(len(by))], "__own", "__before")
