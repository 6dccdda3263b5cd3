"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) are linked. Every round counts the members of each link by shard,
asks linked documents to move to their link's leading shard, and lets through as many moves from shard to shard as
quotas allow: swaps, and what fits the target's free capacity. Who moves is drawn by a hash of the document, so rounds
need no ranking. After the rounds an exact step gives every shard its quota: shards above theirs give up unlinked
documents first, which fill the shards below, so counts are at most one apart (law "rows").

What reaches the driver has a row per shard or pair of shards. Ranks come from bucketed sums, never from one task.

Defined cases: null texts link with nothing and have no bytes; repeated rows, and rows with a null id, each get a slot;
an empty table gives an empty result; fewer documents than shards leave shards empty; extra columns are kept by
balanced_shards, but for any named shard or slot, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, order_hash, running_sum, table

#: SLACK: how far over its even share a shard may go between rounds; the exact step takes it back from unlinked rows.
SHARDS, ROUNDS, SLACK = 40, 4, 0.25


def _quotas(asked: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> list[tuple[int, int, float]]:
    """The share of each kind of move that may happen: swaps, then free room in proportion to what is left."""
    out = []
    room = [max(0, capacity - s) for s in sizes]
    for (i, j), n in asked.items():
        left = {a: m - min(m, asked.get((j, a), 0)) for (a, b), m in asked.items() if b == j}
        swap = min(n, asked.get((j, i), 0))
        extra = room[j] * left[i] / max(1, sum(left.values()))
        out.append((i, j, min(1.0, (swap + extra) / n)))
    return out


def balanced_shards(docs: DataFrame, link: list[str], key: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with shard and slot. link: columns whose equal values link rows (null: none); key: columns that name a row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    state = docs.withColumns({"_order": order_hash(*key), "_linked": F.lit(True)})
    for c in link:
        state = state.withColumn("_linked", F.col("_linked") & F.col(c).isNotNull())
    base = state.withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)).cast("int"))
    state = scratch.save(base, "state")
    total = state.count()
    for r in range(rounds):
        by_shard = state.where("_linked").groupBy(*link, "_shard").agg(F.count("*").alias("_n"))
        lead = by_shard.groupBy(*link).agg(F.max(F.struct("_n", F.xxhash64(*link, "_shard").alias("_tie"), "_shard")).alias("_lead"), F.sum("_n").alias("_members")).where("_members > 1")
        moves = state.join(lead.select(*link, F.col("_lead._shard").alias("_to")), link, "left")
        moves = scratch.save(moves, "moves")
        asked = {(x[0], x[1]): x[2] for x in moves.where("_to <> _shard").groupBy("_shard", "_to").count().collect()}  # a row per pair of shards
        if not asked:
            break
        sizes = {x[0]: x[1] for x in state.groupBy("_shard").count().collect()}  # a row per shard
        quotas = _quotas(asked, [sizes.get(j, 0) for j in range(shards)], int(total / shards * (1 + SLACK)) + 2)
        allowed = F.broadcast(spark.createDataFrame(quotas, "_shard int, _to int, _share double"))  # at most shards squared rows
        draw = F.pmod(F.xxhash64("_order", F.lit(r)), F.lit(1 << 30)) / (1 << 30)
        moved = moves.join(allowed, ["_shard", "_to"], "left").withColumn("_shard", F.when(draw < F.col("_share"), F.col("_to")).otherwise(F.col("_shard")).cast("int"))
        new = scratch.save(moved.select(*state.columns), "state")
        scratch.drop(state, moves)
        state = new

    sizes = {x[0]: x[1] for x in state.groupBy("_shard").count().collect()}
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    filled, room = [0], []
    for j in range(shards):
        filled.append(filled[-1] + max(0, quota[j] - sizes.get(j, 0)))
        room.append(min(quota[j], sizes.get(j, 0)))
    mates = state.where("_linked").groupBy(*link, "_shard").agg(F.count("*").alias("_mates"))
    state = state.join(mates, [*link, "_shard"], "left").withColumn("_one", F.lit(1))
    ranked = running_sum(state, ["_shard"], [F.coalesce(F.col("_mates"), F.lit(1)) < 2], "_order", "_one", "_rank", key)
    ranked = scratch.save(ranked.withColumn("_over", F.col("_rank") >= F.get(F.array(*[F.lit(q) for q in quota]), F.col("_shard"))), "ranked")
    names = [c for c in docs.columns]
    stay = ranked.where("not _over").select(*names, F.col("_shard").alias("shard"), F.col("_rank").cast("long").alias("slot"))
    over = running_sum(ranked.where("_over"), [], [], "_order", "_one", "_g", key)
    to = F.size(F.filter(F.array(*[F.lit(x) for x in filled[1:]]), lambda x: x <= F.col("_g")))
    over = over.withColumn("shard", to.cast("int"))
    slot = F.get(F.array(*[F.lit(x) for x in room]), F.col("shard")) + F.col("_g") - F.get(F.array(*[F.lit(x) for x in filled]), F.col("shard"))
    return stay.unionByName(over.select(*names, "shard", slot.cast("long").alias("slot")))


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, size and text_crc32 with the columns that tell equal texts."""
    return docs.select(*keep, (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"))


LINK = ["text_hash", "text_crc32", "size"]


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(sized(table(spark, sf_dir, "documents")), LINK, ["doc_id", "text_hash"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
