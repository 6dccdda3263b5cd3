"""Toxicity by FTRL-proximal logistic regression over hashed words, n-grams and skip-grams.

Features of a text (presence, hashed to 2**BITS coordinates): each word, each word's leading bytes (4, 5 and 6, so that
inflected forms share a coordinate), word pairs, and pairs that skip one word. Each coordinate has its own
learning rate; L1 keeps the weights sparse, so what is broadcast is bounded by 2**BITS whatever the corpus.

Training reads a bounded sample: at most MAX_TRAIN labelled documents (those with the smallest md5 of their id), PASSES
times over in one task. The sample is drawn from the labels alone, so its ids are a bounded list and no text is shuffled.
Features come from the whole text, in training as in scoring; tasks extract them, and the training task gets the
distinct coordinates alone, at most 2**BITS a document. A toxic example counts TOXIC_WEIGHT times, for they are rare.

The setting was chosen on the training rows alone: fitted to ids of remainder 0, compared on ids of remainder 2.

Defined cases: null and empty texts get the score of the intercept alone; labels that are null are not learned from;
a document labelled twice counts twice; a null id is labelled by nothing, counts as not held out and is scored like any
other; with no labels at all every score is 0.5; repeated documents get a row each; extra columns, whatever their names,
are kept or ignored as asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACES, U64, mix, small_batches, table, trimmed, words_of

BITS = 20
PREFIXES = (4, 5, 6)
MAX_TRAIN, PASSES, TOXIC_WEIGHT = 20_000, 4, 2.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.5
REJECT = 0.7


def text_features(h: np.ndarray, prefixes: list[np.ndarray], first: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates by kind of feature and word; first marks each text's first word, which has no left neighbour."""
    shift = U64(64 - bits)
    none = np.uint32(1 << bits)  # a coordinate of weight 0
    out = np.full((3 + len(prefixes), len(h)), none, dtype=np.uint32)
    out[0] = (h >> shift).astype(np.uint32)
    for k, p in enumerate(prefixes):
        out[3 + k] = (p >> shift).astype(np.uint32)
    if len(h) > 1:
        second = ~first[1:]
        out[1, 1:] = np.where(second, mix(h[:-1] * U64(3) + h[1:] * U64(5)) >> shift, none)
    if len(h) > 2:
        third = ~first[2:] & ~first[1:-1]
        out[2, 2:] = np.where(third, mix(h[:-2] * U64(7) + h[2:] * U64(11)) >> shift, none)
    return out


def _first(offsets: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    return first[:n]


class Ftrl:
    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i):
        z = self.z[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * (TOXIC_WEIGHT if y else 1.0)
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def train(labelled: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Dense float32 weights of length 2**bits + 2: a zero for missing features, then the intercept.

    labelled has doc_id, text, label.
    """

    @trimmed
    def extract(batches):
        for b in batches:
            for lo, offsets, _, _, (h, *pre), _ in words_of(b.column(3), SPACES, PREFIXES):
                f, n = text_features(h, pre, _first(offsets, len(h)), bits), len(offsets) - 1
                own = [np.unique(f[:, offsets[k] : offsets[k + 1]]) for k in range(n)]
                own = [i[i < 1 << bits].astype(np.int32) for i in own]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, n) for c in range(3)), pa.array(own, pa.list_(pa.int32()))], ["key", "tie", "label", "at"])

    @trimmed
    def learn(batches):
        keys, own = [], []
        for b in batches:
            off = b.column(3).offsets.to_numpy()
            flat = b.column(3).values.to_numpy()[off[0] : off[-1]].copy()  # one block a batch
            keys += zip(*(b.column(c).to_pylist() for c in range(3)))
            own += [(flat, i, j) for i, j in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist())]
        bias, model = np.array([(1 << bits) + 1], dtype=np.int32), Ftrl((1 << bits) + 2)
        for _ in range(PASSES):
            for k in sorted(range(len(keys)), key=keys.__getitem__):
                flat, i, j = own[k]
                model.learn(np.concatenate((flat[i:j], bias)), keys[k][2])
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())], ["at", "w"])

    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    known = labelled.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label")).where("label is not null")
    known = known.select("key", F.md5("text").alias("tie"), "label", "text")
    # the sample by its keys alone, then its texts: all rows below the last key and as many of that key as there is room for
    last = known.select("key").orderBy("key").limit(max_train).agg(F.max("key").alias("key"), F.count("*").alias("n")).head()
    sample = known
    if last["n"] == max_train:
        below = known.where(F.col("key") < last["key"])
        sample = below.unionByName(known.where(F.col("key") == last["key"]).orderBy("tie", "label").limit(max_train - below.count()))
    total = sample.mapInArrow(extract, "key string, tie string, label double, at array<int>").repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    w = np.zeros((1 << bits) + 2, dtype=np.float32)
    w[total["at"].to_numpy(dtype=np.int64)] = total["w"]
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The columns to keep (the id, if none) and the score under the name out, for every row. A kept column of that name gives way."""
    bits = int(np.log2(len(weights) - 2))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    keep = tuple(c for c in keep or (id_col,) if c != out)
    rows = docs.select(*keep, *[text_col] * (text_col not in keep))
    at = rows.columns.index(text_col)

    @trimmed
    def apply(batches):
        w = shared.value
        for b in batches:
            logits = np.full(b.num_rows, w[-1], dtype=np.float64)
            for lo, offsets, _, _, (h, *pre), _ in words_of(b.column(at), SPACES, PREFIXES):
                if not len(h):
                    continue
                f = text_features(h, pre, _first(offsets, len(h)), bits)
                doc = np.repeat(np.arange(len(offsets) - 1, dtype=U64), np.diff(offsets))
                values = w[f]
                k, j = np.nonzero(values)
                pairs = np.unique((doc[j] << U64(32)) | f[k, j])  # presence, not counts
                own = (pairs >> U64(32)).astype(np.int64)
                logits[lo : lo + len(offsets) - 1] += np.bincount(own, w[(pairs & U64(0xFFFFFFFF)).astype(np.int64)], len(offsets) - 1)
            p = 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(p)], [*keep, out])

    return rows.mapInArrow(apply, StructType([*(rows.schema[c] for c in keep), StructField(out, DoubleType())]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, label of the labelled documents that are learned from: those of the max_train label rows with the smallest md5 of their id."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("double").alias("label")).where(~held_out() & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "label").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_train rows of two numbers


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(small_batches(spark), sf_dir, "documents")
    weights = train(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
