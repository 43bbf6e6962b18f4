"""The insert journal: positions, cursor pages and the bounded window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialised
from .history import KEY


def with_positions(rows: DataFrame, order: str = "seq", start: int = 0) -> DataFrame:
    """rows with pos: 0, 1, 2, ... in `order`, which is unique.

    Rows are sorted in ranges and written to the shared folder with their range and their place in it, so
    that the counts of the ranges and the positions come from one and the same layout, whatever adaptive
    execution did to it. Only the counts, one per range, are summed in one place.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    placed = materialised(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("place", place))
    part = F.shiftrightunsigned("place", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.withColumn("part", part).join(F.broadcast(base), "part")  # one row per partition
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn("pos", (F.col("base") + within + F.lit(start)).cast("long")).select(*rows.columns, "pos")


def evicted_count(total: int, most: int) -> int:
    """Entries that a window of `most` (0: unbounded) has lost."""
    return max(0, total - most) if most else 0


def window(journal: DataFrame, most: int) -> DataFrame:
    """The last `most` entries of a journal with positions from 0; 0 is unbounded."""
    if not most:
        return journal
    last = journal.agg(F.max("pos")).first()[0]
    return journal.where(F.col("pos") > F.lit((-1 if last is None else last) - most))


def walk(journal: DataFrame, expired: DataFrame | None = None, *, position: int = 0, limit: int | None = None, evicted: int = 0) -> DataFrame:
    """Entries from a position on that are not expired, in order. A position before the window moves up to it."""
    rows = journal.where(F.col("pos") >= max(position, evicted))
    if expired is not None:
        rows = rows.join(expired.select(*KEY), KEY, "left_anti")
    rows = rows.orderBy("pos")
    return rows.limit(limit) if limit is not None else rows
