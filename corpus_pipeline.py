"""A training-corpus pipeline over documents: each stage reads what the one before has written.

toxicity      documents that the trained model scores at the rejection threshold or above go
near_copies   one document (the smallest id) of each group linked by 5-word shingles at similarity 0.8 or more stays
benchmark     contaminated documents go
mixing        documents are drawn for the target weights along the curriculum: up to three copies, or none
sharding      every drawn document gets a shard and a slot

Rows are told apart by a hash of all their columns (96 bits), not by doc_id: rows that share an id, or have none, stay
rows of their own, and rows equal in every column stand for each other.

Defined cases: null, empty and word-less texts link with nothing, are never contaminated and are never drawn, for they
have no words to mix; a null doc_id, and repeated ones, take part like any other; an empty table gives an empty result;
extra columns are kept, but for any named shard or slot, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.llm import curriculum, decontaminate, jaccard, sharding, toxicity
from framemill.llm.common import Scratch, small_batches, table
from framemill.session import ship

#: A list of rows up to this size (20 MB) is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
SAME = ["_a", "_b"]


def _tagged(docs: DataFrame) -> DataFrame:
    """docs with two hashes of all columns and of where nulls lie, which hashes of columns skip."""
    every = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    return docs.withColumns({"_a": F.xxhash64(*every), "_b": F.hash(*every)})


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _one_of_each(tagged: DataFrame, repeated: DataFrame) -> DataFrame:
    """tagged with one row for each of the repeated hashes."""
    if repeated.isEmpty():
        return tagged
    few = _hint(repeated)
    return tagged.join(few, SAME, "left_anti").unionByName(tagged.join(few, SAME, "left_semi").dropDuplicates(SAME))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(small_batches(spark))
    weights = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, weights, keep=tuple(docs.columns), out="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with words, one of each class stays: the smallest doc_id, then the smallest hash."""
    ship(small_batches(spark))
    scratch, tagged = Scratch(spark), _tagged(docs)
    classes = jaccard.ngram_jaccard(tagged, n=5, similarity=(4, 5), keep=tuple(SAME))
    classes = scratch.save(classes.where("node is not null").select("doc_id", *SAME, "node"), "classes")
    place: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *SAME)
    first = classes.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    grouped = classes.join(first, "node")
    gone = grouped.where((F.col("_a") != F.col("first._a")) | (F.col("_b") != F.col("first._b"))).select(*SAME).distinct()
    kept = tagged.join(_hint(scratch.save(gone, "gone")), SAME, "left_anti")
    repeated = classes.groupBy(*SAME).count().where("count > 1").select(*SAME)
    return _one_of_each(kept, scratch.save(repeated, "repeated")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(small_batches(spark))
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(~decontaminate.is_contaminated()).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a draw. Documents are not cut: of the last one of a source, half or more counts as a draw, less as none."""
    scratch, tagged = Scratch(spark), _tagged(docs)
    planned = curriculum.plan(tagged.select("doc_id", "source", "text", *SAME), ["doc_id", *SAME])
    planned = scratch.save(planned.select(*SAME, "size", "draws"), "planned")
    drawn = planned.select(*SAME, "size", F.explode("draws").alias("d")).where("2 * d.words >= size").select(*SAME, F.col("d.position").alias("_position"))
    repeated = planned.groupBy(*SAME).count().where("count > 1").select(*SAME)
    rows = _one_of_each(tagged, scratch.save(repeated, "repeated")).join(drawn, SAME)
    return rows.repartitionByRange("_position", *SAME).sortWithinPartitions("_position", *SAME).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot; copies of a document have places of their own."""
    tagged = _tagged(docs)
    placed = sharding.balanced_shards(sharding.sized(tagged, tuple(SAME)), sharding.LINK, SAME)
    one = tagged.dropDuplicates(SAME)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return one.select(*own, *SAME).join(placed.select(*SAME, "shard", "slot"), SAME).select(*own, "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: The trained model is beyond SQL; tests/llm/test_pipeline.py holds near_copies and benchmark against brute force, the other stages to invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
