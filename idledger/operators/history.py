"""Insert-if-absent, membership and tombstones over identifier tables.

Inputs carry the 128-bit key in hash_hi and hash_lo and an explicit order in `seq`. Every operator is
one shuffle on the key at most; small sides are left to the planner's own size checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import halves_of, md5_hex

KEY = ["hash_hi", "hash_lo"]
INSERTED, DUPLICATE = "inserted", "duplicate"


def keyed(rows: DataFrame, text: Column | str) -> DataFrame:
    """rows with hash_hi and hash_lo of a text column; a null text has the key (0, 0), which no text has.

    So keys are never null, and joins on them need no null check, which would hash every row once more.
    """
    taken, digest = {c.lower() for c in rows.columns}, "digest"
    while digest in taken:
        digest += "_"
    hi, lo = halves_of(F.col(digest))  # the digest is a step of its own, so that it is computed once
    none = F.lit(0).cast("long")
    hashed = rows.withColumn(digest, md5_hex(F.col(text) if isinstance(text, str) else text))
    return hashed.withColumns({"hash_hi": F.coalesce(hi, none), "hash_lo": F.coalesce(lo, none)}).drop(digest)


def keep_first(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each key. The rank limit is applied before the shuffle too, so a hot key moves few rows."""
    w = Window.partitionBy(*KEY).orderBy(order)
    return rows.withColumn("rank_in_key", F.row_number().over(w)).where("rank_in_key = 1").drop("rank_in_key")


def first_seq(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Each key with its least order; a plain aggregate, combined before the shuffle."""
    return rows.groupBy(*KEY).agg(F.min(order).alias("first_seq"))


def add_status(rows: DataFrame, stored: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """rows with status: inserted for the first row of a key that is not stored, else duplicate. `order` is unique."""
    firsts = first_seq(rows, order)
    if stored is not None:
        firsts = firsts.join(stored.select(*KEY), KEY, "left_anti")
    marked = rows.join(firsts, KEY, "left")
    is_first = F.coalesce(F.col(order) == F.col("first_seq"), F.lit(False))
    return marked.withColumn("status", F.when(is_first, INSERTED).otherwise(DUPLICATE)).drop("first_seq")


def new_only(rows: DataFrame, stored: DataFrame, order: str = "seq") -> DataFrame:
    """The rows that an add would insert."""
    return keep_first(rows.join(stored, KEY, "left_anti"), order)


def lookup(probes: DataFrame, stored: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """probes with found: the key is stored and not expired.

    The store is first reduced to the probed keys, by the planner's choice of join: a batch that fits the
    size check for broadcasts is sent to the store's files, and no stored key is shuffled.
    """
    present = stored.select(*KEY).join(probes.select(*KEY), KEY, "left_semi").distinct()
    if expired is not None:
        present = present.join(expired.select(*KEY), KEY, "left_anti")
    return probes.join(present.withColumn("found", F.lit(True)), KEY, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def hits(probes: DataFrame, stored: DataFrame) -> DataFrame:
    return probes.join(stored.select(*KEY), KEY, "left_semi")


def expire(keys: DataFrame, expired: DataFrame | None = None) -> DataFrame:
    """The tombstones that are new; an identifier need not have been added."""
    fresh = keys.select(*KEY).distinct()
    return fresh.join(expired.select(*KEY), KEY, "left_anti") if expired is not None else fresh


def clear_expired(expired: DataFrame, inserted: DataFrame) -> DataFrame:
    """The tombstones left after inserts: only a real insert clears one."""
    return expired.join(inserted.select(*KEY), KEY, "left_anti")


def replay(ops: DataFrame) -> DataFrame:
    """ops (seq, op: add, expire or lookup, key) with result, as if they ran one by one in seq order.

    A key is inserted by its first add; a tombstone set before that insert is cleared by it, a later one
    stays, whatever is added again. While no generation is evicted this needs no fold: the result
    follows from the first add of the key and its last earlier expire.
    """
    by_key = Window.partitionBy(*KEY)
    earlier = by_key.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.withColumn("fa", F.min(F.when(F.col("op") == "add", F.col("seq"))).over(by_key))
    rows = rows.withColumn("pe", F.max(F.when(F.col("op") == "expire", F.col("seq"))).over(earlier))
    stored = F.coalesce(F.col("fa") < F.col("seq"), F.lit(False))
    cleared = stored & F.coalesce(F.col("pe") < F.col("fa"), F.lit(False))
    alive = F.col("pe").isNull() | cleared
    result = (
        F.when(F.col("op") == "add", F.when(F.col("seq") == F.col("fa"), INSERTED).otherwise(DUPLICATE))
        .when(F.col("op") == "expire", F.when(alive, "expired").otherwise("noop"))
        .otherwise(F.when(stored & alive, "hit").otherwise("miss"))
    )
    return rows.withColumn("result", result).drop("fa", "pe")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Keys stored more than once, with how often: an audit of the table."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")
