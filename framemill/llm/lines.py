"""Line dedup: lines that many sites share are boilerplate and are removed everywhere.

A line's spread is its number of distinct sites, from HyperLogLog sketches merged by line hash. A sketch decides only
where its estimate is further than BAND standard errors from the threshold; nearer lines get exact distinct counts.

Lines are hashed (64 bits of the trimmed line) and pre-aggregated by line and site before any sketch is built, so a
line that a third of all rows hold reaches one task only as a row per site and task. Texts are shuffled once, by
document, with the positions to remove.

Defined cases: a null text stays null and has no lines; a null site counts for no line; blank lines and lines with one
site stay; repeated rows each keep their own row; a text that loses all its lines becomes empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_SITES, LOG_K, BAND = 5, 12, 6.0


def _lines(text) -> F.Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines with at least min_sites distinct sites; lines has (line, site)."""
    seen = scratch.save(lines.where("site is not null").groupBy("line", "site").agg(F.lit(1).alias("one")).drop("one"), "line-sites")
    error = BAND * 1.04 / 2 ** (LOG_K / 2)
    spread = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"))
    spread = scratch.save(spread.where(F.col("sites") >= min_sites * (1 - error) - 1), "spread")
    far = spread.where(F.col("sites") > min_sites * (1 + error) + 1).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + error) + 1)
    exact = seen.join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return far.union(exact.select("line"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the cleaned text."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    key = F.xxhash64(F.col("text")), F.coalesce(F.length("text"), F.lit(-1))
    trimmed = lambda x: F.btrim(x, F.lit(" \t\r"))
    placed = rows.select("doc_id", key[0].alias("k0"), key[1].alias("k1"), "site", F.posexplode(_lines(F.col("text"))).alias("pos", "raw"))
    placed = placed.where(trimmed(F.col("raw")) != "").select("doc_id", "k0", "k1", "pos", "site", F.xxhash64(trimmed(F.col("raw"))).alias("line"))
    common = scratch.save(boilerplate_lines(placed.select("line", "site"), scratch, min_sites), "boilerplate")
    # equal rows share one list of positions
    gone = placed.join(common, "line", "left_semi").groupBy("doc_id", "k0", "k1").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g"), F.col("k0").alias("g0"), F.col("k1").alias("g1"), "gone")
    cut = rows.select("doc_id", key[0].alias("k0"), key[1].alias("k1"), _lines(F.col("text")).alias("lines"))
    cut = cut.join(gone, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("k0") == F.col("g0")) & (F.col("k1") == F.col("g1")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return cut.select("doc_id", F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH lines AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
common AS (SELECT trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''
           GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON trim(l.raw, ' ' || chr(9) || chr(13)) = c.line)
SELECT d.doc_id, count(m.pos) AS n_lines, count(m.pos) FILTER (m.gone) AS n_removed,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(m.raw, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') END AS text
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""
