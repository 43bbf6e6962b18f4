"""Latency and counter series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples are kept within these bounds, in nanoseconds.
LEAST_NS, MOST_NS = 1, 1_000_000_000


def bounded(column: str) -> F.Column:
    return F.greatest(F.lit(float(LEAST_NS)), F.least(F.lit(float(MOST_NS)), F.col(column)))


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the least value that so large a share of its rows does not exceed, and the maximum.

    Equal values are counted before the shuffle, and a group is read in order with a running sum, which
    spills: no group has to fit in memory.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.max(value).cast("double").alias("max"))
    placed = counts.withColumn("upto", F.sum("n").over(upto)).join(totals, by)
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(p).cast("decimal(9,6)") * F.col("total")), F.col(value))).cast("double").alias(k) for k, p in shares.items()]
    return placed.groupBy(*by).agg(*picks, F.first("max").alias("max"))


def percentiles(rows: DataFrame, by: list[str], value: str, *, exact: bool = True) -> DataFrame:
    """p50, p95, p99 and the maximum of a value by group: exact, or within a thousandth by a mergeable sketch."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        return exact_percentiles(rows, by, value, shares)
    picks = [F.percentile_approx(value, p, 10_000).cast("double").alias(k) for k, p in shares.items()]
    return rows.groupBy(*by).agg(*picks, F.max(value).cast("double").alias("max"))


def deltas(rows: DataFrame, by: list[str], counter: str, order: str) -> DataFrame:
    """rows with delta: the counter less the one before, at least zero; the first one counts from zero."""
    before = F.lag(counter, 1, 0).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("delta", F.greatest(F.col(counter) - before, F.lit(0)))


def tail(rows: DataFrame, order: str, n: int = 8) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def head_and_tail(rows: DataFrame, order: str, head: int = 12, last: int = 20) -> DataFrame:
    """The first and the last rows, without the middle."""
    return rows.orderBy(order).limit(head).unionByName(rows.orderBy(F.desc(order)).limit(last)).distinct()


def warmup_timeline(rows: DataFrame, batch: str, value: str, elapsed: str, slo: float) -> DataFrame:
    """p50 and p99 of each batch of lookups, when it ended, and whether it is the first within the objective."""
    spread = exact_percentiles(rows, [batch], value, {"p50": 0.5, "p99": 0.99}).drop("max")
    per = spread.join(rows.groupBy(batch).agg(F.max(elapsed).alias("elapsed_ms")), batch).select(batch, "p50", "p99", "elapsed_ms")
    steady = per.where(F.col("p99") <= slo).agg(F.min(batch)).first()[0]
    return per.withColumn("first_steady", F.coalesce(F.col(batch) == F.lit(steady), F.lit(False)))
