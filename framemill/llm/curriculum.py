"""Mixing sources to target weights along a time-varying curriculum.

A source's weight follows a linear schedule over training time 0 to 1; its integral is the source's target share. The
words a source has delivered by time t are the integrated schedule, so the time at which a document's words come up is
its inverse at the document's place in the source's order (a hash order, from bucketed running sums). Sources whose
target exceeds their size start over, at most three times; documents are finally range-sorted by position.

The last document of a pass is cut where the target ends, so every source takes its target to the word.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; sources without words have
target 0; repeated rows, and rows with a null id, each take part, those of one id in the order of
their texts' hashes, so reruns agree; an empty table gives an empty result; extra columns are
kept, but for any that has the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, order_hash, running_sum, table

#: Fixed values of the contract.
WEIGHTS, MOST = (5, 2, 1), 3
#: Weight at time 0 as a multiple of the mean, by the source's place: fading, steady, growing sources.
STARTS = (1.5, 1.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target, start: weights by code point order, nothing above MOST times its size.

    Targets that hit the ceiling free their excess for the others by weight; with sources sorted by the level at which
    they hit it, the final level is the first that no later source hits. A row per source.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    pick = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), place)
    s = s.withColumns({"weight": pick(WEIGHTS, "long"), "start": pick(STARTS, "double")})
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, upto, rest = Window.partitionBy(), by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("weight").over(rest))
    fits = F.col("level") * F.col("weight") <= MOST * F.col("source_size")
    s = s.withColumns({"_place": F.row_number().over(by), "_fits": fits})
    s = s.withColumn("level", F.min(F.when(F.col("_fits"), F.struct("_place", "level"))).over(every)["level"])
    return s.select("source", "source_size", "start", F.least(F.col("level") * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def _when(x: Column, start: Column) -> Column:
    """The time by which a share x of a source's target is delivered; weight runs from start to 2 - start."""
    bend = 1 - start
    root = (F.sqrt(start * start + 4 * bend * x) - start) / (2 * F.when(bend != 0, bend).otherwise(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(bend == 0, x).otherwise(root)))


def plan(docs: DataFrame, key: list[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken and draws (copy, words, position), in no order; the text only beside further columns."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(*({"size", "source_size", "target", "taken", "draws"} - {*key, text_col, source_col}))
    rows = docs.withColumns({"size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"), "_order": order_hash(*key), "_tie": F.xxhash64(text_col)}).withColumn("source", F.col(source_col))
    # words are counted once: without further columns the counts are saved, the text is left behind
    slim = rows.select(*dict.fromkeys([*key, "source", "size", "_order", "_tie"]))
    whole = set(docs.columns) - {text_col} <= set(slim.columns)
    slim = scratch.save(slim, "sizes") if whole else slim
    rows = slim if whole else rows
    targets = scratch.save(source_targets(slim).withColumnRenamed("source", "_source"), "targets")
    placed = running_sum(rows, ["source"], [], "_order", "size", "_before", [*key, "size", "_tie"])
    placed = placed.join(targets, placed["source"].eqNullSafe(F.col("_source")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("_passes", passes).withColumn("_rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("_passes") * F.col("source_size")))
    placed = placed.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before"))))

    def draw(c: Column) -> Column:
        words = F.when(c < F.col("_passes"), F.col("size")).otherwise(F.col("_part"))
        x = (c * F.col("source_size") + F.col("_before") + words / 2) / F.col("target")
        return F.struct(c.cast("int").alias("copy"), words.alias("words"), _when(x, F.col("start")).alias("position"))

    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_passes")), draw), lambda d: d["words"] > 0)
    placed = placed.withColumns({"draws": F.when((F.col("target") > 0) & (F.col("size") > 0), draws).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>")), "taken": F.col("size") * F.col("_passes") + F.col("_part")})
    return placed.drop("_order", "_tie", "_before", "_passes", "_rest", "_part", "_source", "start")


def schedule(planned: DataFrame, columns: list[str]) -> DataFrame:
    """A row per draw, range-sorted by position."""
    drawn = planned.select(*columns, F.explode("draws").alias("d")).select(*columns, "d.copy", "d.words", "d.position")
    return drawn.repartitionByRange("position", *columns[:1]).sortWithinPartitions("position", *columns[:1])


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = docs.select("doc_id", "source", "text")
    planned = plan(sizes, ["doc_id"])
    first = F.coalesce(F.get("draws", F.lit(0))["position"], F.lit(2.0))
    out = planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("_first"))
    return out.repartitionByRange("_first", "doc_id").sortWithinPartitions("_first", "doc_id").drop("_first")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS o FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - {MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1),
lv AS (SELECT level FROM s2 WHERE level * weight <= {MOST} * source_size ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(lv.level * weight, ({MOST} * source_size)::DOUBLE) AS target FROM s2, lv),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * passes + greatest(0, least(size, greatest(0, round(target)::BIGINT - passes * source_size) - before)) AS taken FROM p"""
