"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked inside their source. A row of rank r in a source of n rows
stands at (2r + 1) / 2n of that source; sorted by this fraction, every stretch of the sequence holds the
sources in the proportions of the whole table, and cutting it into equal stretches gives shards whose row
counts differ by one at most.

Null, empty and repeated rows are rows like any other: a null text has no bytes, a null source is a source
of its own, and equal rows take neighbouring places. An empty table gives an empty frame. Columns of the
input with clashing names are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import RANGES, hash_bucket, numbered, source_key


def proportional_shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row of ``docs``.

    ``slot`` counts from 0 without gaps inside a shard. Only these narrow columns are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        source_key().alias("_source"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_hash"),
    )
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = numbered(rows, ["_source"], F.col("_hash"), hash_bucket(F.col("_hash")), ties, "_rank")
    share = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_rank_total")).cast("double")
    placed = placed.withColumn("_share", share)
    bucket = F.least(F.floor(F.col("_share") * RANGES), F.lit(RANGES - 1)).cast("int")
    whole = numbered(placed, [], F.col("_share"), bucket, [F.col("_hash"), *ties], "_at")
    shard = F.expr(f"_at * {shards} div _at_total")
    first = F.expr(f"(shard * _at_total + {shards - 1}) div {shards}")
    return whole.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents into one folder per shard, each in slot order. ``doc_id`` must be unique."""
    spots = placed.select("doc_id", F.col("shard").alias("shard_id"), F.col("slot").alias("shard_slot"))
    joined = docs.join(spots, "doc_id")
    ranged = joined.repartitionByRange(shards * 4, "shard_id", "shard_slot").sortWithinPartitions("shard_id", "shard_slot")
    ranged.write.partitionBy("shard_id").parquet(path)
