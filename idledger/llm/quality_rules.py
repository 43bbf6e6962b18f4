"""Quality by weak supervision: rules vote or abstain, and a label model weighs the votes.

DataFrame functions only. Every document is read once; the votes are then counted by pattern, and
expectation-maximisation runs as aggregations over the at most 3 ** rules patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import WORD_SPACE, SetAside, materialised

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: Very common words of the languages in view.
COMMON = "the of and to a in is that for with der die das und von den mit ist ein eine le la les de des et un une que el los las en y".split()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count_of(text: Column, marks: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, marks, ""))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more."""

    def covered(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        at = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(F.sort_array(F.transform(at, lambda x: x["i"])), start, step, lambda acc: acc["n"])

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(placed, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(_let(windows, count))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at. A null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))
    word_counts = _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            repeated_words(w).alias("repeated"),
            F.size(F.array_intersect(F.transform(F.slice(w, 1, F.size(w)), F.lower), F.lit(COMMON))).alias("common"),
        ),
    )
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), line_counts.alias("lines"), word_counts.alias("words"))
    text = F.col("text")
    return read.select(
        "doc_id",
        F.xxhash64(text).alias("text_key"),
        F.col("words.n").cast("long").alias("n_words"),
        F.char_length(F.translate(text, WORD_SPACE, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.col("lines.n") - F.col("lines.kinds")).cast("long").alias("n_dup_lines"),
        F.col("words.repeated").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("words.common").cast("long").alias("n_common"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _count_of(text, "!").cast("long").alias("n_shouts"),
    )


@dataclass(frozen=True)
class Rule:
    """good and bad are conditions over text_stats; a rule abstains where neither holds.

    on_good and on_bad are how often its votes are believed right, on good and on bad documents, before
    any document is seen. A rule that looks for one defect votes good where the defect is missing: it is
    nearly always right on good documents and seldom on bad ones, which mostly have other defects.
    """

    name: str
    bad: str
    good: str = "true"
    on_good: float = 0.98
    on_bad: float = 0.3

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), F.lit(0)).when(F.expr(self.good), F.lit(1))


RULES = (
    Rule("length", f"n_words < {MIN_WORDS}", "n_words >= 100", 0.7, 0.5),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words", 0.8, 0.4),
    Rule("common_words", "n_common <= 1", "n_common >= 6 or 20 * n_common >= n_words", 0.8, 0.5),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("many_symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("capitals", "10 * n_upper > 4 * word_chars"),
    Rule("shouting", "10 * n_shouts > n_words"),
)


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents, and for each rule how often its votes are right on good and on bad ones."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """The probability that a document is good; abstaining says nothing."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            odds = odds + F.when(v == 1, math.log(g / (1 - b))).when(v == 0, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rules: tuple[Rule, ...], *, rounds: int = 40, tolerance: float = 1e-4, weight: float = 10.0, share: float = 0.8) -> LabelModel:
    """Expectation-maximisation over vote patterns (v0, v1, ..., rows).

    It starts from each rule's on_good and on_bad, which stay in the estimates as beta priors worth
    `weight` votes in each class: that settles the direction, and the estimate of a rule that never
    votes. Without rows the prior is the model.
    """
    priors = tuple((r.on_good, r.on_bad) for r in rules)
    model = LabelModel(share, tuple(g for g, _ in priors), tuple(b for _, b in priors))
    votes = [F.col(f"v{j}") for j in range(len(rules))]
    for _ in range(rounds):
        weighed = patterns.withColumn("good", model.posterior(votes) * F.col("rows"))
        bad = F.col("rows") - F.col("good")
        sums = [F.sum("good"), F.sum(bad)]
        for v in votes:
            sums += [F.sum(F.when(v == value, of).otherwise(0.0)) for of, value in ((F.col("good"), 1), (F.col("good"), 0), (bad, 0), (bad, 1))]
        got = [float(x or 0.0) for x in weighed.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        right = lambda k, t: (got[k] + t * weight) / (got[k] + got[k + 1] + weight)
        new = LabelModel(
            right(0, share),
            tuple(right(2 + 4 * j, g) for j, (g, _) in enumerate(priors)),
            tuple(right(4 + 4 * j, b) for j, (_, b) in enumerate(priors)),
        )
        moved = max(abs(a - b) for a, b in zip((model.share, *model.on_good, *model.on_bad), (new.share, *new.on_good, *new.on_bad), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, threshold: float = 0.5) -> DataFrame:
    """A row per document: its counts, base_failed, quality (the posterior probability) and kept.

    Null and empty texts have no words and fail the base; a very long text is read whole. A posterior equal
    to the threshold keeps. Repeated rows are judged alike and each counts; a null doc_id stays null; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    names = [f"v{j}" for j in range(len(rules))]
    stats = text_stats(docs).withColumns({n: r.vote() for n, r in zip(names, rules, strict=True)})
    stats = materialised(stats)
    patterns = materialised(stats.groupBy(*names).agg(F.count("*").alias("rows")).coalesce(1))
    model = fit(patterns, rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key",
        failed.alias("base_failed"), model.posterior([F.col(n) for n in names]).alias("quality"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, with their columns. Rows that share a doc_id are kept or dropped by their own text."""
    out = judge(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    own = SetAside(docs)
    key = F.xxhash64(F.coalesce(own.column("text").cast("string"), F.lit("")))
    return own.restored(own.rows.join(out, own.column("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (key == F.col("bad_key")), "left_anti"))
