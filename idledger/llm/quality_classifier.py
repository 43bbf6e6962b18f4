"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all text, give every document
the log ratio of its probabilities. Adding Gumbel noise and taking the largest sums draws documents
without replacement, with chances in proportion to the ratios.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import materialised, unit_interval

BUCKETS = 10_000
#: Labelled documents that the target model learns from at most: those with the least hashes of doc_id.
EXAMPLES = 20_000
SMOOTHING = 0.5
BINS = 4096


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words, repeats included; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B1) ^ h[1:] * np.uint64(0x85EBCA77) ^ np.uint64(1)
    mixed = np.concatenate([h, pairs]) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column `text` of all rows. Tasks send one row per bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(ngram_buckets(text, buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    out = np.zeros(buckets)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    t, r = target + smoothing, raw + smoothing
    return np.log(t / t.sum()) - np.log(r / r.sum())


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by counting in ever narrower ranges; -inf if there are not more than k rows."""
    low, high, count = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if count <= k:
        return float("-inf")
    if k <= 0:
        return float("inf")
    inside, need = rows, k
    while low < high:
        step = (high - low) / BINS
        place = F.least(F.lit(BINS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(step))).cast("int")
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:  # at most BINS rows
            if b["n"] >= need:
                break
            need -= b["n"]
        if b["n"] == need:
            return b["low"]
        low, high = b["low"], b["high"]
        inside = rows.where(F.col(column).between(low, high))
    return low


def resample(docs: DataFrame, labels: DataFrame, *, fraction: float | None = None, buckets: int = BUCKETS, examples: int = EXAMPLES) -> DataFrame:
    """A row per document: doc_id, log_weight, sample_key (log_weight plus Gumbel noise) and kept.

    The target is the labelled documents of quality 1, at most `examples`; the raw model counts all
    documents. kept marks the `fraction` of rows with the largest keys (by default the labelled share of
    quality 1, or all without labels), and every row that ties with the last of them. The noise depends
    on doc_id and text alone, so repeated rows stay or go together. Null and empty texts have weight
    zero; a very long text counts with all its words. A null doc_id stays null; other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    good, every = marked.agg(F.sum((F.col("quality") > 0).cast("int")), F.count("*")).first()
    if fraction is None:
        fraction = good / every if every and good else 1.0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    chosen = marked.where("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).select("doc_id")
    target = ngram_counts(rows.join(F.broadcast(chosen), "doc_id"), buckets)  # chosen: at most `examples` rows
    ratios = log_ratios(target, ngram_counts(rows, buckets)) if target.any() else np.zeros(buckets)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        return pd.Series([float(sent.value[ngram_buckets(t, buckets)].sum()) for t in texts])

    noise = -F.log(-F.log(unit_interval(F.lit("sample"), "doc_id", F.xxhash64("text"))))
    scored = rows.select("doc_id", weigh("text").alias("log_weight"), noise.alias("noise"))
    scored = materialised(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("sample_key")))
    last = kth_largest(scored, "sample_key", round(fraction * scored.count()))
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(last))
