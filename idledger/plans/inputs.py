"""Identifier tables derived from the driver's tables, defined alike for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import keyed


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores at least: a table of few files would be hashed by few of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def epoch_us(column: str):
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, message_id, event_type, user_id, value, ts_us and the key."""
    rows = dealt(read(spark, sf_dir, "events")).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("<"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type"), F.lit("@events>")).alias("message_id"),
        "event_type", "user_id", "value", epoch_us("ts").alias("ts_us"),
    )
    return keyed(rows, "message_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(dealt(read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("seq"), "text"), "text").drop("text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(read(spark, sf_dir, "lineitem")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("<"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("@li>")).alias("message_id"))
    return keyed(rows, "message_id")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(read(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("<"), F.col("o_orderkey").cast("string"), F.lit(".1@li>")).alias("message_id"))
    return keyed(rows, "message_id")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "expire").when(F.col("event_type") == "signup", "lookup").otherwise("add")
    return events(spark, sf_dir).withColumn("op", kind)


def _half(text: str, first: int) -> str:
    digits = " || ".join(f"substr(md5({text}), {first + k}, 2)" for k in range(14, -2, -2))
    return f"('0x' || {digits})::UBIGINT"


def _signed(u: str) -> str:
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN ({u}::HUGEINT - 18446744073709551616)::BIGINT ELSE {u}::BIGINT END)"


def with_key(source: str, text: str) -> str:
    """SQL: source with uhi, ulo (unsigned) and hash_hi, hash_lo (signed)."""
    inner = f"SELECT *, {_half(text, 1)} AS uhi, {_half(text, 17)} AS ulo FROM ({source})"
    return f"SELECT *, {_signed('uhi')} AS hash_hi, {_signed('ulo')} AS hash_lo FROM ({inner})"


E = with_key("SELECT event_id AS seq, '<' || user_id || '.' || event_type || '@events>' AS message_id, event_type, user_id, value, epoch_us(ts) AS ts_us FROM events", "message_id")
D = with_key("SELECT doc_id AS seq, text FROM documents", "text")
L = with_key("SELECT '<' || l_orderkey || '.' || l_linenumber || '@li>' AS message_id FROM lineitem", "message_id")
O = with_key("SELECT o_orderkey AS seq, '<' || o_orderkey || '.1@li>' AS message_id FROM orders", "message_id")  # noqa: E741
OPS = f"SELECT *, CASE event_type WHEN 'error' THEN 'expire' WHEN 'signup' THEN 'lookup' ELSE 'add' END AS op FROM ({E})"
