"""Mixing to target weights with soft domain membership.

DataFrame functions only. A naive Bayes classifier over hashed words, trained on the labelled table,
gives every document a probability for each domain. Projected-gradient least squares then fits one
nonnegative rate per document, such that the expected tokens of each domain match the targets. Each
step needs one aggregate over the documents, of one number per domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import SetAside, materialised, unit_interval
from .quality_rules import _let, words_of

#: Hash buckets of words, and labelled documents that the classifier learns from at most.
BUCKETS, EXAMPLES = 1024, 5_000
#: Target shares are the domains' shares raised to this power.
TEMPERATURE = 0.7


def _buckets(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes: per domain its log share and the log probability of each bucket."""

    domains: tuple[str, ...]
    share: tuple[float, ...]
    bucket: tuple[tuple[float, ...], ...]

    def posteriors(self, text: Column) -> Column:
        """An array of probabilities in the order of `domains`, from all words of the text."""
        tables = [F.lit(list(b)) for b in self.bucket]
        first = F.struct(*(F.lit(s).alias(f"d{k}") for k, s in enumerate(self.share)))
        add = lambda acc, b: F.struct(*((acc[f"d{k}"] + F.get(t, b)).alias(f"d{k}") for k, t in enumerate(tables)))
        logs = F.aggregate(_buckets(text), first, add, lambda acc: F.array(*(acc[f"d{k}"] for k in range(len(self.domains)))))

        def normal(raw: Column) -> Column:
            weights = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
            return _let(weights, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)))

        return _let(logs, normal)


def train_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", *, examples: int = EXAMPLES) -> DomainModel:
    """Fit the classifier on at most `examples` documents of the labelled table, those with the least hashes of doc_id.

    Null ids, domains and texts are passed over. Without a labelled document there is one domain, "".
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), F.col("text").cast("string").alias("text"))
    known = known.where("domain is not null and text is not null").join(F.broadcast(chosen), "doc_id").select("domain", "text").distinct()
    words = known.select("domain", F.explode(_buckets(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    known = materialised(known.groupBy("domain").agg(F.count("*").alias("n")).coalesce(1))
    totals = {r["domain"]: r["n"] for r in known.collect()}
    if not totals:
        return DomainModel(("",), (0.0,), ((0.0,) * BUCKETS,))
    names = tuple(sorted(totals))
    counts = {d: [1.0] * BUCKETS for d in names}
    for r in words.collect():  # at most domains * BUCKETS rows
        counts[r["domain"]][r["bucket"]] += r["n"]
    every = sum(totals.values())
    return DomainModel(
        names,
        tuple(math.log(totals[d] / every) for d in names),
        tuple(tuple(math.log(c / sum(counts[d])) for c in counts[d]) for d in names),
    )


def flattened(shares: dict[str, float], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Shares raised to a power and scaled to one: small domains gain."""
    raised = {d: s**temperature if s > 0 else 0.0 for d, s in shares.items()}
    total = sum(raised.values()) or 1.0
    return {d: r / total for d, r in raised.items()}


def fit_rates(members: DataFrame, domains: int, targets: list[float], *, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """`members` (tokens, p: array of probabilities, and other columns) with a rate for each row.

    It minimises the sum over domains d of (expected tokens of d - target of d) ** 2 / tokens of d over
    rates of at least zero, from rates of one. In the metric that weighs a rate by its document's
    tokens, the gradient is the membership-weighted sum of (expected - target) / tokens of d, and the
    curvature is at most one: the rows of its matrix are shares that add up to one. So a step of one
    always descends.
    """
    p = [F.get("p", F.lit(k)) for k in range(domains)]
    held = members.agg(*(F.sum(F.col("tokens") * x).alias(f"s{k}") for k, x in enumerate(p))).first()
    tokens = [float(x or 0.0) for x in held]
    expected = tokens
    current = members.withColumn("rate", F.lit(1.0))
    for step in range(rounds):
        pull = [(e - t) / n if n > 0 else 0.0 for e, t, n in zip(expected, targets, tokens, strict=True)]
        if max(map(abs, pull)) < tolerance:
            break
        down = F.lit(0.0)
        for x, g in zip(p, pull, strict=True):
            down = down + x * F.lit(g)
        current = current.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - down))
        if step % 10 == 9:
            current = materialised(current)
        got = current.agg(*(F.sum(F.col("tokens") * F.col("rate") * x).alias(f"s{k}") for k, x in enumerate(p))).first()
        before, expected = expected, [float(x or 0.0) for x in got]
        if max(abs(a - b) / max(1.0, n) for a, b, n in zip(before, expected, tokens, strict=True)) < tolerance / 100:
            break
    return current


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", *, weights: dict[str, float] | None = None, budget: float | None = None, examples: int = EXAMPLES) -> DataFrame:
    """A row per document: doc_id, domain (the likeliest), membership (its probability), tokens, rate, copies.

    tokens are the words of the whole text. weights are the target shares by domain; by default the
    expected shares, flattened. budget is the expected number of tokens after mixing; by default the
    most that the weights allow without repeating a document on average. copies is the rate rounded up
    or down at random, by a number that depends on doc_id and text alone, so that it equals the rate on
    average. Null and empty texts have no tokens and rate one; a very long text counts with all its words.
    Of equally likely domains the first by name is given. Repeated rows have equal rates and copies each;
    a null doc_id stays null; other columns, whatever their names, are ignored; an empty table gives no rows.

    The default budget hangs on the domain that is rarest against its target: with targets of shares to
    the power 0.7, the share of tokens kept is the rarest domain's share to the power 0.3, over the sum of
    the raised shares. A larger budget keeps more and repeats documents of the rare domains.
    """
    model = train_domains(docs, labels, domain, examples=examples)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = read.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.size(words_of(F.col("text"))).cast("long").alias("tokens"),
        model.posteriors(F.col("text")).alias("p"),
    )
    rows = materialised(rows)
    n = len(model.domains)
    held = [float(x or 0.0) for x in rows.agg(*(F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(f"s{k}") for k in range(n))).first()]
    shares = {d: h / (sum(held) or 1.0) for d, h in zip(model.domains, held, strict=True)}
    wanted = weights or flattened(shares)
    total = sum(wanted.get(d, 0.0) for d in model.domains) or 1.0
    goal = [wanted.get(d, 0.0) / total for d in model.domains]
    if budget is None:
        budget = min((h / g for h, g in zip(held, goal, strict=True) if g > 0), default=0.0)
    fitted = fit_rates(rows, n, [g * budget for g in goal])
    fitted = fitted.withColumn("rate", F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("rate")))
    whole = F.floor("rate")
    up = unit_interval(F.lit("mix"), "doc_id", "text_key") < F.col("rate") - whole
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return fitted.select(
        "doc_id",
        F.get(F.array(*map(F.lit, model.domains)), best).alias("domain"),
        F.array_max("p").alias("membership"),
        "tokens", "rate",
        (whole + up.cast("int")).cast("long").alias("copies"),
        "text_key",
    )


def draw(docs: DataFrame, labels: DataFrame, domain: str = "lang", **options) -> DataFrame:
    """The documents, each as often as mix() says, with their columns."""
    drawn = mix(docs, labels, domain, **options).select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), "copies").where("copies > 0").distinct()
    own = SetAside(docs)
    key = F.xxhash64(F.coalesce(own.column("text").cast("string"), F.lit("")))
    taken = own.rows.join(drawn, own.column("doc_id").cast("long").eqNullSafe(F.col("mix_id")) & (key == F.col("mix_key")))
    often = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return own.restored(taken.withColumn("copy", F.explode(often)))
