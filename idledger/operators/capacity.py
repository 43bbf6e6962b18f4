"""Capacity planning: what a sharded table of fixed slots holds, as column arithmetic over settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a shard's header and of a slot, and of a filter's header and checksum.
HEADER, SLOT, FILTER_EXTRA = 64, 32, 24
FILTER_BITS = 1 << 24


def grid(spark: SparkSession) -> DataFrame:
    """Settings around the defaults: shards, slots, load percent, retained generations, inserts per second, disk budget."""
    i = F.col("id")
    return spark.range(240).select(
        i.alias("i"), F.expr("shiftleft(1L, cast(5 + id % 5 as int))").alias("shards"), F.expr("shiftleft(1L, cast(18 + id % 7 as int))").alias("slots"),
        (60 + i % 30).alias("load"), (1 + i % 12).alias("generations"), (F.lit(1000) * (1 + i % 400)).alias("inserts_per_second"), (F.lit(1 << 38) * (1 + i % 16)).alias("disk"),
    )


def plan(settings: DataFrame) -> DataFrame:
    """Ids and bytes of a generation, of the retained ones and of a disk budget, and how long they take to fill."""
    whole = lambda a, b: F.floor(a / b).cast("long")
    rows = settings.withColumn("limit_per_shard", whole(F.col("slots") * F.col("load"), F.lit(100)))
    rows = rows.withColumn("ids_per_generation", F.col("shards") * F.col("limit_per_shard"))
    rows = rows.withColumn("data_bytes", F.col("shards") * (HEADER + SLOT * F.col("slots")))
    rows = rows.withColumn("bytes_per_generation", F.col("data_bytes") + F.col("shards") * (FILTER_EXTRA + FILTER_BITS // 8))
    rows = rows.withColumn("ids_retained", F.col("ids_per_generation") * F.col("generations"))
    rows = rows.withColumn("generations_on_disk", whole(F.col("disk").cast("decimal(20,0)"), F.col("bytes_per_generation").cast("decimal(20,0)")))
    rows = rows.withColumn("ids_on_disk", F.col("generations_on_disk") * F.col("ids_per_generation"))
    rows = rows.withColumn("fill_seconds", F.round(F.col("ids_per_generation") / F.col("inserts_per_second"), 3))
    return rows.withColumn("window_seconds", F.round(F.col("ids_retained") / F.col("inserts_per_second"), 3)).drop("shards", "slots", "load", "generations", "inserts_per_second", "disk")


ORACLE = f"""WITH s AS (SELECT i, (1::BIGINT << (5 + i % 5)::INTEGER) AS shards, (1::BIGINT << (18 + i % 7)::INTEGER) AS slots, 60 + i % 30 AS load, 1 + i % 12 AS generations, 1000 * (1 + i % 400) AS ips, {1 << 38} * (1 + i % 16) AS disk FROM (SELECT unnest(range(240)) AS i)),
a AS (SELECT *, (slots * load) // 100 AS limit_per_shard, shards * ({HEADER} + {SLOT} * slots) AS data_bytes FROM s),
b AS (SELECT *, shards * limit_per_shard AS ids_per_generation, data_bytes + shards * {FILTER_EXTRA + FILTER_BITS // 8} AS bytes_per_generation FROM a)
SELECT i, limit_per_shard, ids_per_generation, data_bytes, bytes_per_generation, ids_per_generation * generations AS ids_retained, disk // bytes_per_generation AS generations_on_disk,
  (disk // bytes_per_generation) * ids_per_generation AS ids_on_disk, round(ids_per_generation::DOUBLE / ips, 3) AS fill_seconds, round((ids_per_generation * generations)::DOUBLE / ips, 3) AS window_seconds FROM b"""
