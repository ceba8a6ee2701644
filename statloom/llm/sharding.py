"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Every step is a Spark expression. The jumps of a key are drawn from xxhash64(key, step), so that they
do not depend on the number of shards: appending a shard moves rows into the new shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import cut_lineage

#: Rows of one input task that share a block; a block's rows of one shard are numbered in one task.
BLOCK_BITS = 16
#: Jumps tried for every row; the few keys that need more get as many as the shards allow.
USUAL_JUMPS = 12


def _jumps(key: Column, shards: int, start: Column, first: int, last: int) -> Column:
    """Go on from (b, j): while j < shards, b becomes j and j the next jump beyond it."""

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33).cast("double") + 1
        onward = F.floor((state["j"] + 1) * (F.lit(2.0**31) / draw)).cast("double")
        return F.when(
            state["j"] < shards, F.struct(state["j"].alias("b"), onward.alias("j"))
        ).otherwise(state)

    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), start, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a key: int. A null key is a key like any other."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = key.cast("string")
    usual = _jumps(key, shards, F.struct(F.lit(-1.0).alias("b"), F.lit(0.0).alias("j")), 0, USUAL_JUMPS)
    # each jump goes at least one shard on, so that as many steps as shards always end it
    whole = F.when(usual["j"] >= shards, usual).otherwise(_jumps(key, shards, usual, USUAL_JUMPS + 1, USUAL_JUMPS + shards))
    return whole["b"].cast("int")


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", grown: int | None = None) -> DataFrame:
    """Add `shard`, `slot` (0, 1, ... without a gap within a shard) and `grown_shard` (with `grown` shards).

    Slots follow the input order. Rows are numbered per (shard, block of input rows); the blocks' offsets
    come from their counts, so no task holds a whole shard, whatever key is common. Rows are written
    to the shared folder once, since blocks are input positions. Rows with a null key, repeated rows
    and an empty table need no rule of their own.
    """
    placed = rows.withColumns(
        {
            "shard": jump_shard(F.col(key), shards),
            "grown_shard": jump_shard(F.col(key), grown) if grown else F.lit(None).cast("int"),
            "_at": F.monotonically_increasing_id(),
        }
    ).withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    placed = cut_lineage(placed, "sharded")
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_block").orderBy("_at")
    numbered = placed.withColumn("_i", F.row_number().over(within))
    return (
        numbered.join(offsets, ["shard", "_block"])
        .withColumn("slot", F.col("_offset") + F.col("_i") - 1)
        .drop("_at", "_block", "_i", "_offset")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document (a null text is empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_rows(sized, shards, "doc_id", shards + 1)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
