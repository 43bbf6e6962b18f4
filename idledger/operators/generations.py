"""Shards, generations, rollover at batch boundaries, and retention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import shard_of


def routed(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard_id", shard_of(F.col("hash_lo"), shards))


def routing_counts(rows: DataFrame, shards: int) -> DataFrame:
    return routed(rows, shards).groupBy("shard_id").agg(F.count("*").alias("rows"))


def shard_pressure(stored: DataFrame, shards: int, *, failures: DataFrame | None = None) -> DataFrame:
    """A row per shard, empty ones too: used_slots, full_failures, pending (within an int), from 0 up."""
    spark = stored.sparkSession
    used = routed(stored, shards).groupBy("shard_id").agg(F.count("*").alias("used_slots"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    out = every.join(F.broadcast(used), "shard_id", "left")  # used has a row per shard
    if failures is not None:
        per = failures.groupBy("shard_id").agg(F.sum("full_failures").alias("full_failures"), F.sum("pending").alias("pending"))
        out = out.join(F.broadcast(per), "shard_id", "left")
    else:
        out = out.withColumns({"full_failures": F.lit(0).cast("long"), "pending": F.lit(0).cast("long")})
    bounded = F.greatest(F.lit(0).cast("long"), F.least(F.col("pending"), F.lit((1 << 31) - 1).cast("long")))
    return out.select("shard_id", F.coalesce("used_slots", F.lit(0)).alias("used_slots"), F.coalesce("full_failures", F.lit(0)).cast("long").alias("full_failures"), F.coalesce(bounded, F.lit(0)).cast("long").alias("pending"))


def hottest_shard(pressure: DataFrame, score: Column | None = None) -> DataFrame:
    """The shard with the highest score, the lowest id of equals."""
    rows = pressure.withColumn("score", score if score is not None else F.col("full_failures") + F.col("pending"))
    return rows.orderBy(F.desc("score"), "shard_id").limit(1).select("shard_id", "score")


def snapshot(pressure: DataFrame, generation: int = 1) -> DataFrame:
    """One row of totals over the shards of the active generation."""
    return pressure.agg(
        F.lit(generation).alias("active_generation"),
        F.coalesce(F.sum("used_slots"), F.lit(0)).alias("used_slots"),
        F.coalesce(F.sum("full_failures"), F.lit(0)).alias("full_failures"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"),
        F.max("used_slots").alias("max_used_slots"),
    )


def generations_of(inserted: DataFrame, *, shards: int, threshold: int) -> DataFrame:
    """(batch, generation) for every batch from 0 to the last one with an insert.

    inserted has a row per insert with batch and shard_id. After a batch that takes any shard of the
    active generation to the threshold, the next batch opens a new generation. Each generation depends
    on the one before, so this is a fold: over metadata of one number per batch and shard, sorted by
    batch, in one pass that holds the active generation's shards alone.
    """
    per = inserted.groupBy("batch", "shard_id").agg(F.count("*").alias("n"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, generation, batch, full = np.zeros(shards, np.int64), 1, 0, False
        for frame in frames:
            out = []
            for at, shard, n in zip(frame["batch"].tolist(), frame["shard_id"].tolist(), frame["n"].tolist(), strict=True):
                while batch < at:
                    out.append((batch, generation))
                    if full:
                        used[:], generation, full = 0, generation + 1, False
                    batch += 1
                used[shard] += n
                full = full or bool(0 < threshold <= used[shard])
            yield pd.DataFrame(out, columns=["batch", "generation"])
        if used.any() or batch:
            yield pd.DataFrame({"batch": [batch], "generation": [generation]})

    sized = per.select(F.col("batch").cast("long"), F.col("shard_id").cast("int"), "n").repartition(1).sortWithinPartitions("batch")
    return sized.mapInPandas(fold, "batch long, generation int")


def retained(entries: DataFrame, generations: int, column: str = "generation") -> DataFrame:
    """entries of the newest `generations` generations. The bound is a literal, so a partitioned table is pruned."""
    newest = entries.agg(F.max(column)).first()[0]
    return entries.where(F.col(column) > F.lit((newest or 0) - generations))


def checksums(entries: DataFrame, shards: int) -> DataFrame:
    """(shard_id, entries, checksum): equal for equal sets of keys, in whatever order and files they lie."""
    mixed = F.col("hash_hi").bitwiseXOR(F.col("hash_lo"))
    return routed(entries, shards).groupBy("shard_id").agg(F.count("*").alias("entries"), F.bit_xor(mixed).alias("checksum"))


def listing(entries: DataFrame, column: str = "generation") -> DataFrame:
    """Generations with their number of entries and age, the newest being 0."""
    per = entries.groupBy(column).agg(F.count("*").alias("entries"))
    newest = per.agg(F.max(column)).first()[0]
    return per.withColumn("age", F.lit(newest) - F.col(column)).orderBy(F.desc(column))


def up_to(entries: DataFrame, generation: int, column: str = "generation") -> DataFrame:
    """Entries of a generation and all before it."""
    return entries.where(F.col(column) <= generation)
