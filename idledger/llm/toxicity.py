"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Every word of a bounded number of labelled documents is a term. A block-max inverted index of them goes
to every task, and each text is searched in it: its neighbours vote with weights that fall with distance.
A logistic curve, fitted on the votes that each labelled example gets from the others, turns votes into
probabilities. The inverse document frequency is scaled by how well a term tells the labels apart,
from LEAST for words that do not to one; no term is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import SetAside, fetch, give_back, make_room, materialised, share, shared_path

#: Labelled documents that are learnt from at most: those with the least hashes of doc_id.
EXAMPLES = 20_000
#: The scale of a term whose evidence (twice the log likelihood ratio) is zero, and the evidence that brings it half way to one.
LEAST, HALF_WAY = 0.03, 25.0
NEIGHBOURS = 15
BLOCK = 64
#: Terms in one of so many documents have tiles instead of lists. Blocks that a search completes first, and queries that it runs together.
SHARED, FIRST_BLOCKS, TOGETHER = 16, 16, 256
#: More than single precision can err by in a cosine.
MARGIN = np.float32(1e-4)
_WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a text in lower case, as ascending 64-bit hashes, and how often each occurs."""
    words = Counter(_WORD.findall((text or "").lower()))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(keys)
    return keys[order], np.fromiter(words.values(), np.int64, len(words))[order]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0] ... ends[0] - 1, starts[1] ... in a row."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """An inverted index over documents in blocks, with every term's greatest weight in each block.

    search() is exact. Terms in few documents have lists of postings, which are added up first. Terms in
    many have their weights in one tile per block: what they can add to a document is at most the sum of
    their maxima in its block. Blocks that cannot reach a query's k-th best sum so far are not completed;
    its most promising ones are completed first, which raises that sum. Sums are in single precision up
    to here; documents within MARGIN of the k-th best are scored anew in double precision.
    """

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, block: int = BLOCK):
        """The documents' numbers of terms, one after the other, and their weights; `sizes` terms each. Documents with the
        same weightiest term share blocks."""
        starts = np.cumsum(sizes) - sizes
        chief = np.zeros(len(keys), np.int64)
        if len(term):  # every document has a term
            top = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, starts), sizes))
            chief = term[top[np.searchsorted(top, starts)]]
        order = np.lexsort((keys, chief))
        post = _ranges(starts[order], (starts + sizes)[order])
        self.keys, self.block, self.terms = keys[order], block, terms
        self.blocks = -(-len(order) // block)
        self.doc_starts = np.concatenate([[0], np.cumsum(sizes[order])])
        self.term, self.weight = term[post].astype(np.int32), weight[post]
        del post
        doc = np.repeat(np.arange(len(order), dtype=np.int32), sizes[order])
        df = np.bincount(self.term, minlength=terms)
        common = np.flatnonzero(df * SHARED >= max(1, len(order)))
        self.tile_row = np.full(terms, -1, np.int32)
        self.tile_row[common] = np.arange(len(common))
        tiled = self.tile_row[self.term] >= 0
        self.tiles = np.zeros((self.blocks, len(common), block), np.float32)
        self.tiles[doc[tiled] // block, self.tile_row[self.term[tiled]], doc[tiled] % block] = self.weight[tiled]
        self.most = np.ascontiguousarray(self.tiles.max(axis=2, initial=0.0).T)
        listed = np.flatnonzero(~tiled)
        listed = listed[np.argsort(self.term[listed], kind="stable")]
        self.list_doc, self.list_weight = doc[listed], self.weight[listed].astype(np.float32)
        self.starts = np.searchsorted(self.term[listed], np.arange(terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the positions and scores of the k best, best first, ties (to 12 digits) by key;
        documents that share no term are not found, nor is the one at `without`."""
        out = []
        for low in range(0, len(queries), TOGETHER):
            out += self._search(queries[low : low + TOGETHER], k, without[low : low + TOGETHER] if without else None)
        return out

    def _search(self, queries, k, without) -> list[tuple[np.ndarray, np.ndarray]]:
        width = self.blocks * self.block
        if not width:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        sums = np.empty((len(queries), width), np.float32)
        asked = np.zeros((len(queries), self.tiles.shape[1]), np.float32)
        for i, (at, weight) in enumerate(queries):
            row = self.tile_row[at]
            asked[i, row[row >= 0]] = weight[row >= 0]
            rare, own = at[row < 0], weight[row < 0].astype(np.float32)
            a, e = self.starts[rare], self.starts[rare + 1]
            post = _ranges(a, e)
            sums[i] = np.bincount(self.list_doc[post], self.list_weight[post] * np.repeat(own, e - a), width)
        for i, x in enumerate(without or []):
            if x is not None:
                sums[i, x] = -np.inf
        view = sums.reshape(len(queries), self.blocks, self.block)

        def least() -> np.ndarray:
            """What the k-th best sums reach at least: the k-th best of the blocks' best."""
            best = view.max(axis=2)
            return np.partition(best, self.blocks - k, axis=1)[:, self.blocks - k, None] - MARGIN if self.blocks >= k else np.full((len(queries), 1), -np.inf, np.float32)

        bound = view.max(axis=2) + asked @ self.most
        done = np.zeros(bound.shape, bool)
        np.put_along_axis(done, np.argsort(-bound, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        self._complete(view, asked, done)
        rest = (bound >= least()) & ~done
        self._complete(view, asked, rest)
        done |= rest
        near = (view >= np.maximum(least(), 1e-30)[:, :, None]) & done[:, :, None]
        scratch, out = np.zeros(self.terms), []
        for i, (at, weight) in enumerate(queries):
            docs = np.flatnonzero(near[i].ravel())
            if len(docs) > k:
                docs = docs[sums[i, docs] >= np.partition(sums[i, docs], -k)[-k] - MARGIN]
            scratch[at] = weight
            out.append(self._exact(scratch, docs, k))
            scratch[at] = 0.0
        return out

    def _complete(self, view: np.ndarray, asked: np.ndarray, which: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            some = np.flatnonzero(which[:, b])
            view[some, b] += asked[some] @ self.tiles[b]

    def _exact(self, query: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, e = self.doc_starts[docs], self.doc_starts[docs + 1]
        post = _ranges(a, e)
        scores = np.bincount(np.repeat(np.arange(len(docs)), e - a), query[self.term[post]] * self.weight[post], len(docs))
        top = np.lexsort((self.keys[docs], -np.round(scores, 12)))[:k]
        return docs[top], scores[top]


class ToxicityModel:
    def __init__(self, ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, neighbours: int = NEIGHBOURS):
        """Examples: doc_ids, whether toxic (1 or 0), how many terms each has, and all of these in a row, as terms_of gives them."""
        self.neighbours = neighbours
        self.terms = np.unique(terms)
        number = np.searchsorted(self.terms, terms).astype(np.int32)
        df = np.bincount(number, minlength=len(self.terms))
        label, bads = toxic.astype(float), float(toxic.sum())
        in_bad = np.bincount(number, np.repeat(label, sizes), len(self.terms))
        self.idf = np.log((len(ids) + 1) / np.maximum(df, 1)) * scale_of(in_bad, df - in_bad, bads, len(ids) - bads)
        weight = (1 + np.log(counts)) * self.idf[number]
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), sizes), weight * weight, len(ids)))
        weight /= np.repeat(norm, sizes)
        known = sizes > 0
        self.index = BlockMaxIndex(ids[known], sizes[known], number, weight, len(self.terms))
        by_key = dict(zip(ids.tolist(), label.tolist(), strict=True))
        self.label = np.array([by_key[k] for k in self.index.keys.tolist()], float)
        self.share = (bads + 1) / (len(ids) + 2)
        self.blank_score = (float(label[~known].sum()) + 0.5) / (int((~known).sum()) + 5)

    def _unit(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[at]
        return at, weight / math.sqrt(float((weight * weight).sum())) if len(at) else weight

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's known terms, ascending, and their TF-IDF weights, of length one."""
        keys, counts = terms_of(text)
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        known = self.terms[at] == keys
        return self._unit(at[known], counts[known])

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The weighted share of toxic neighbours, shrunk to the examples' share, with the neighbours and cosines."""
        out = []
        for docs, cosine in self.index.search(vectors, self.neighbours, without):
            near = 1 / (0.05 + np.maximum(0.0, 1 - cosine))
            out.append((float(((near * self.label[docs]).sum() + self.share) / (near.sum() + 1)), docs, cosine))
        return out

    @staticmethod
    def score(votes: float, curve: tuple[float, float]) -> float:
        slope, shift = curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, slope * math.log(votes / (1 - votes)) + shift))))

    def judge(self, texts: list[str | None], curve: tuple[float, float]) -> list[tuple[float, list[int], list[float]]]:
        vectors = [self.vector(t) for t in texts]
        out: list = [(self.blank_score, [], [])] * len(texts)
        known = [i for i, v in enumerate(vectors) if len(v[0])]
        for i, (votes, docs, cosine) in zip(known, self.votes([vectors[i] for i in known]), strict=True):
            out[i] = (self.score(votes, curve), self.index.keys[docs].tolist(), cosine.tolist())
        return out


def calibrated(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """A logistic curve from votes to labels, by Newton's method with a light pull to the identity."""
    x, a, b = np.log(votes / (1 - votes)), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = p * (1 - p)
        grad = np.array([((p - labels) * x).sum() + (a - 1), (p - labels).sum() + b])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and math.isfinite(a) and math.isfinite(b) else (1.0, 0.0)


@dataclass(frozen=True)
class Trained:
    """Where in the shared folder a model is, and its curve."""

    place: str
    curve: tuple[float, float]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scale_of(bad: np.ndarray, good: np.ndarray, bads: float, goods: float) -> np.ndarray:
    """For terms in so many toxic and other examples, of `bads` and `goods`: a factor that rises from LEAST to one with
    the evidence that a term and the label go together, in either direction."""
    total = bads + goods

    def part(seen: np.ndarray, row: np.ndarray, column: float) -> np.ndarray:
        return 2 * seen * np.log(np.where(seen > 0, seen * total / np.maximum(row * column, 1e-300), 1.0))

    df = bad + good
    evidence = part(bad, df, bads) + part(good, df, goods) + part(bads - bad, total - df, bads) + part(goods - good, total - df, goods)
    squared = np.maximum(0.0, evidence) ** 2
    return LEAST + (1 - LEAST) * squared / (squared + HALF_WAY**2)


def train(docs: DataFrame, labels: DataFrame, *, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Trained:
    """Learn from the labelled documents that are not held out; at most `examples` of them, from their whole texts.

    A doc_id that is labelled twice counts as toxic if any label says so; one with several texts stands
    for the greatest; a text that several ids have is one example, toxic if any label says so. Null ids
    and labels are passed over. Without usable labels every document gets the same low score.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # chosen: at most `examples` rows
    known = materialised(known)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room()
        for batch in batches:
            got = [terms_of(t) for t in batch["text"]]
            names = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "name": names, "terms": [g[0].tobytes() for g in got], "counts": [g[1].astype(np.uint32).tobytes() for g in got]})

    place = shared_path(docs.sparkSession, "toxicity-model")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room()
        # Copies of a text are one example: else a copied text's own words look like signs of its label.
        first: dict[bytes, list] = {}
        for batch in batches:
            for name, doc_id, toxic, terms, counts in zip(batch["name"], batch["doc_id"].tolist(), batch["toxic"].tolist(), batch["terms"], batch["counts"], strict=True):
                old = first.setdefault(name, [doc_id, 0, terms, counts])
                old[:2] = min(old[0], doc_id), old[1] | int(toxic > 0)
        batch = terms = counts = None
        kept = sorted(first.values(), key=lambda x: x[0])
        parts = [np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64), np.array([len(x[2]) // 8 for x in kept], np.int64)]
        parts += [np.frombuffer(b"".join(x[2] for x in kept), np.uint64), np.frombuffer(b"".join(x[3] for x in kept), np.uint32)]
        first = kept = old = None  # before the model takes its room
        give_back()
        model = ToxicityModel(*parts, neighbours)
        parts = None
        share(place, model)
        searched = len(model.index.keys)
        model = None
        give_back()
        yield pd.DataFrame({"searched": [searched]})

    rows = known.mapInPandas(read, "doc_id long, toxic int, name binary, terms binary, counts binary").repartition(1)  # at most `examples` rows
    searched = rows.mapInPandas(build, "searched long").first()[0]
    if searched < 2:
        return Trained(place, (1.0, 0.0))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = fetch(place)
        at = {k: i for i, k in enumerate(m.index.keys.tolist())}
        for batch in batches:
            own = [(m.vector(t), at[d]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if d in at]
            got = m.votes([v for v, _ in own], [i for _, i in own])
            yield pd.DataFrame({"votes": [g[0] for g in got], "toxic": [int(m.label[i]) for _, i in own]})

    tried = known.mapInPandas(others, "votes double, toxic int").toPandas().sort_values(["votes", "toxic"])  # at most `examples` rows
    return Trained(place, calibrated(tried["votes"].to_numpy(), tried["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Trained) -> DataFrame:
    """docs with score, predicted, and evidence: the doc_ids and cosines of the labelled neighbours, nearest first.

    Null and empty texts, and those without a word of any example, get the share of toxic ones among
    such examples, and no neighbours. A very long text is read whole, and is one vector like any other.
    Columns of docs with the names of the new ones are replaced.
    """
    place, curve = model.place, model.curve

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(fetch(place).judge(texts.tolist(), curve), columns=["score", "neighbours", "cosines"])

    out = docs.withColumn("toxicity", judged(F.col("text").cast("string")))
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted", "neighbours", "cosines")]
    return out.select(*own, F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.neighbours").alias("neighbours"), F.col("toxicity.cosines").alias("cosines"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, neighbours, cosines.

    Repeated rows are scored each, and alike; a null doc_id stays null and is not held out. lang, source
    and doc_id are never inputs of a score. Ties between neighbours go to the smaller doc_id. Null, empty
    and very long texts are as in score(). Other columns of docs and labels, whatever their names, are
    ignored. An empty table gives no rows.
    """
    model = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = score(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours", "cosines")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names; rows are judged as in toxicity()."""
    model = train(docs, labels, **options)
    own = SetAside(docs)
    kept = score(own.rows.withColumn("text", own.column("text")), model).where("predicted = 0")
    return own.restored(kept)
