"""Bloom filters as tables of 64-bit words, combined across tasks by bitwise or."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import BLOOM_HASHES, bloom_bits


def _exploded(rows: DataFrame, bits: int, hashes: int) -> DataFrame:
    at = F.explode(bloom_bits(F.col("hash_hi"), F.col("hash_lo"), bits, hashes))
    return rows.withColumn("bit", at).withColumns({"word_idx": F.shiftrightunsigned("bit", 6).cast("int"), "place": F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int")})


def _listed(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else by


def build(rows: DataFrame, bits: int, hashes: int = BLOOM_HASHES, by: str | list[str] = "shard_id") -> DataFrame:
    """(shard_id, word_idx, word) of the keys in rows; words without a bit are absent."""
    marked = _exploded(rows, bits, hashes).withColumn("one", F.expr("shiftleft(1L, place)"))
    return marked.groupBy(*_listed(by), "word_idx").agg(F.bit_or("one").alias("word"))


def may_contain(rows: DataFrame, words: DataFrame, bits: int, hashes: int = BLOOM_HASHES, by: str = "shard_id", id_column: str = "seq") -> DataFrame:
    """(id, may_contain): whether all bits of a key are set; false is certain."""
    probed = _exploded(rows, bits, hashes).join(words, [*_listed(by), "word_idx"], "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(word, place) & 1L") == 1, F.lit(False))
    return probed.groupBy(id_column).agg(F.bool_and(hit).alias("may_contain"))


def merge(words: DataFrame, more: DataFrame, by: str = "shard_id") -> DataFrame:
    return words.unionByName(more).groupBy(*_listed(by), "word_idx").agg(F.bit_or("word").alias("word"))
