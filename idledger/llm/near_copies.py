"""Near copies by SimHash links and exact Jaccard similarity of word-shingle sets.

The first candidates are the links of the SimHash search by tiles (simhash.py), over fingerprints of the
sets. Fingerprints of similar sets can differ in more bits than its radius, so an exact way follows for
the rest: put the shingles of all sets in one order; two sets that are similar enough then share one of
their first few. The order puts common shingles last, which decides how many candidates there are, never
which pairs are found. A group of like sets stands in the lists of many shingles: each list first gives
two pairs a set at most, which mostly link all of such a group. Every other candidate pair is then
held against the exact similarity, other than pairs that are linked already by others. Before texts are
moved for that, a parity sketch of each set, some bits for each word, rules out what cannot be similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import make_room, materialised, numbered, release, renumbered
from .components import components
from .simhash import SEED, keep_least, majority, near_links

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that fingerprints of SimHash candidates differ in at most.
RADIUS = 3
#: Texts whose shingles are counted for the order, one in ORDER_SHARE at least, and the shingles that are known as common at most.
ORDER_TEXTS, ORDER_SHARE, COMMON = 10_000, 4, 400_000
#: The least and most bits of a parity sketch.
SKETCH = 64, 1 << 16
#: Texts whose shingles are handed on at once.
SLICE = 128
#: Bits of a key that say whether its set can be a candidate; others with the same bits are read along and joined with nothing.
BITS = 26
_SLACK = 1e-9
#: An odd number that scatters what it multiplies.
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; all words are one shingle if there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64))


def set_key(shingles: np.ndarray, seed: int = SEED) -> int:
    """A signed long that names a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed)).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - _SLACK) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - _SLACK


def parity_sketch(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, by a power of two of half the set's size or more: whether an odd number of hashes has it."""
    bits = min(SKETCH[1], max(SKETCH[0], 1 << max(0, (len(shingles) - 1) // 2).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """How many shingles at least are in one of two sets alone, by their sketches: each odd residue of the one takes one."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id; the set's key, fingerprint, size and sketch."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make_room()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingle_set(text, shingle)
                rows.append((set_key(own), majority(own), len(own), parity_sketch(own)))
            key, mark, size, sketch = zip(*rows, strict=True) if rows else ((),) * 4
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "key": np.array(key, np.int64), "mark": np.array(mark, np.uint64).view(np.int64), "size": np.array(size, np.int32), "sketch": list(sketch)})

    return renumbered(numbered(docs, "doc_id", text="string").mapInPandas(keyed, "doc_id long, no_id boolean, key long, mark long, size int, sketch binary"))


def _linked(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys whose fingerprints the SimHash search links: one key of each fingerprint with the others, and with one of the next."""
    sets = keyed.where("size > 0").select("mark", "key").distinct()
    chief = materialised(sets.groupBy("mark").agg(F.min("key").alias("chief")))
    alike = sets.join(chief, "mark").where("key <> chief").select(F.col("chief").alias("a"), F.col("key").alias("b"))
    ends = [chief.select(F.col("mark").alias(x), F.col("chief").alias(f"{x}_key")) for x in "ab"]
    across = near_links(chief.select("mark"), radius).join(ends[0], "a").join(ends[1], "b").select("a_key", "b_key")
    return alike.unionByName(across.toDF("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(docs: DataFrame, rows: int, shingle: int) -> np.ndarray:
    """Shingles that several texts of a sample share, the most common last: COMMON at most, where equally common ones are all in or all out."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                yield pd.DataFrame({"token": np.concatenate([shingle_set(t, shingle) for t in batch["text"].iloc[low : low + SLICE]]).view(np.int64)})

    parts = max(1, min(rows // ORDER_TEXTS, ORDER_SHARE))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text").distinct()
    found = materialised(some.mapInPandas(exploded, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2"))
    least, room = 3, COMMON
    for n, tokens in sorted(found.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        room -= tokens
        if room < 0:
            least = n + 1
            break
    top = found.where(F.col("n") >= least).toArrow()
    token = top["token"].to_numpy()
    return token[np.lexsort((-token, top["n"].to_numpy()))].view(np.uint64)


def _prefixes(docs: DataFrame, common: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(token, key, n, place): the first shingles of each set in the common order; place counts from 0."""
    by_token = np.argsort(common, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((common[by_token], by_token))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, ranks = sent.value
        seen: set[int] = set()
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                out = []
                for text in batch["text"].iloc[low : low + SLICE]:
                    own = shingle_set(text, shingle)
                    key = set_key(own)
                    if not len(own) or key in seen:
                        continue
                    seen.add(key)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        rank = np.where(tokens[at] == own, ranks[at] + 1, 0)
                        own = own[np.argsort(rank, kind="stable")]
                    out.append((own[: prefix_length(len(own), similarity)].copy(), key, len(own)))
                if out:
                    lengths = [len(o[0]) for o in out]
                    yield pd.DataFrame({
                        "token": np.concatenate([o[0] for o in out]).view(np.int64),
                        "key": np.repeat(np.array([o[1] for o in out], np.int64), lengths),
                        "n": np.repeat(np.array([o[2] for o in out], np.int32), lengths),
                        "place": np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]),
                    })

    return docs.mapInPandas(first, "token long, key long, n int, place int")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in pieces that never part rows of one token; each (token, key) once. Rows come sorted by token, n, key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        token = batch["token"].to_numpy()
        last = int(np.searchsorted(token, token[-1]))  # tokens ascend
        if held and held[-1]["token"].iloc[-1] == token[-1]:
            held.append(batch)
            continue
        held.append(batch.iloc[:last])
        yield pd.concat(held).drop_duplicates(["token", "key"], ignore_index=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held).drop_duplicates(["token", "key"], ignore_index=True)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", "n", "key")


def _fits(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j of one token can belong to similar sets. At the first token that two sets share, only what follows can be shared as well."""
    most = np.minimum(n[i] - place[i], n[j] - place[j])
    return most * (1 + similarity) >= similarity * (n[i] + n[j]) - _SLACK


def _shared(prefixes: DataFrame, similarity: float) -> DataFrame:
    """The rows that fit another row of their token."""

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches):
            token, n, place = run["token"].to_numpy(), run["n"].to_numpy(np.int64), run["place"].to_numpy(np.int64)
            fit, at, d = np.zeros(len(run), bool), np.arange(len(run)), 1
            while len(at):
                at = at[at + d < len(run)]
                at = at[(token[at] == token[at + d]) & (n[at] >= similarity * n[at + d] - _SLACK)]
                open_at = at[~(fit[at] & fit[at + d])]
                found = open_at[_fits(n, place, open_at, open_at + d, similarity)]
                fit[found] = fit[found + d] = True
                if fit.all():
                    break
                d += 1
            yield run[fit]

    return _sorted(prefixes).mapInPandas(shared, "token long, key long, n int, place int")


def _spanning(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): keys under one token that fit each other, two pairs of each row at most: with the next in the token's list, where
    equal sizes come in an order of the token's own, and with the row whose prefix reaches the token first, which has the
    fewest rare shingles. A group's sets meet many others of it in this way, and its centre, whatever its size."""

    def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches):
            token, key = run["token"].to_numpy(), run["key"].to_numpy()
            n, place = run["n"].to_numpy(np.int64), run["place"].to_numpy(np.int64)
            listed = np.lexsort(((key ^ token).view(np.uint64) * _SCATTER, n, token))
            central = np.lexsort((key, place, token))
            hub = central[np.searchsorted(token[central], token[central])]
            i, j = np.concatenate([listed[:-1], central]), np.concatenate([listed[1:], hub])
            alike = (token[i] == token[j]) & (key[i] != key[j]) & _fits(n, place, i, j, similarity)
            i, j = i[alike], j[alike]
            yield pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j])}).drop_duplicates()

    return _sorted(shared).mapInPandas(spanning, "a long, b long").distinct()


def _pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): keys of different labels under one token that fit each other."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(batches):
            token, key, label = (run[c].to_numpy() for c in ("token", "key", "label"))
            n, place = run["n"].to_numpy(np.int64), run["place"].to_numpy(np.int64)
            at, d = np.arange(len(run)), 1
            while len(at):
                at = at[at + d < len(run)]
                at = at[(token[at] == token[at + d]) & (n[at] >= similarity * n[at + d] - _SLACK)]
                fit = at[(label[at] != label[at + d]) & _fits(n, place, at, at + d, similarity)]
                if len(fit):
                    yield pd.DataFrame({"a": np.minimum(key[fit], key[fit + d]), "b": np.maximum(key[fit], key[fit + d])}).drop_duplicates()
                d += 1

    return _sorted(shared).mapInPandas(pairs, "a long, b long").distinct()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key's last BITS bits, in words of 64: what reaches the driver has a fixed bound."""
    low = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    found = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _texts(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, packed) of the keys in `wanted` and of few others: a text of each set, compressed, which takes a third of the
    room of its shingles' hashes and moves between tasks for each pair."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, seen, pack = sent.value, set(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                out = {}
                for text in batch["text"].iloc[low : low + SLICE]:
                    key = set_key(shingle_set(text, shingle))
                    at = key & ((1 << BITS) - 1)
                    if int(bits[at >> 6]) >> (at & 63) & 1 and key not in seen:
                        seen.add(key)
                        out[key] = pack((text or "").encode("utf-8", "replace"))
                if out:
                    yield pd.DataFrame({"key": np.array(list(out), np.int64), "packed": list(out.values())})

    return docs.mapInPandas(texts, "key long, packed binary").dropDuplicates(["key"])


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs less those whose sketches show that they are not similar."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = np.fromiter(map(_least_difference, batch["x"], batch["y"]), np.int64, len(batch))
            total = batch["m"].to_numpy(np.int64) + batch["n"].to_numpy(np.int64)
            yield batch.loc[least * (1 + similarity) <= (1 - similarity) * total + 2 * _SLACK, ["a", "b"]]

    x, y = (sketches.select(F.col("key").alias(k), F.col("size").alias(n), F.col("sketch").alias(v)) for k, n, v in (("a", "m", "x"), ("b", "n", "y")))
    return pairs.join(x, "a").join(y, "b").mapInPandas(judge, "a long, b long")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose texts are similar."""
    likely = materialised(_likely(pairs, sketches, similarity))
    release(docs.sparkSession)
    known = _texts(docs, likely.select(F.explode(F.array("a", "b")).alias("key")), shingle)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def set_of(key: int, packed: bytes) -> np.ndarray:
            if key not in held:
                if len(held) >= SLICE:
                    held.clear()
                held[key] = shingle_set(zstandard.decompress(packed).decode("utf-8"), shingle)
            return held[key]

        for batch in batches:
            fit = [similar(set_of(a, x), set_of(b, y), similarity) for a, x, b, y in zip(batch["a"].tolist(), batch["x"], batch["b"].tolist(), batch["y"], strict=True)]
            yield batch.loc[np.array(fit, bool), ["a", "b"]]

    both = likely.join(known.select(F.col("key").alias("a"), F.col("packed").alias("x")), "a").join(known.select(F.col("key").alias("b"), F.col("packed").alias("y")), "b")
    found = materialised(both.mapInPandas(judge, "a long, b long"))
    release(docs.sparkSession)
    return found


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that a chain of texts leads to, each at least `similarity` to the next.

    The similarity of two texts is that of their sets of `shingle` words (Jaccard), words as in
    near_duplicates. Texts without words are like each other alone. A null doc_id is kept and never
    chosen; a component of such rows alone has a null component_id. Repeated rows share a set and give a
    row each. A very long text is read whole and is one set. Other columns are ignored. An empty table
    gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = materialised(_keys(texts, shingle))
    sketches = keyed.select("key", "size", "sketch").dropDuplicates(["key"])
    common = _common(texts, keyed.count(), shingle)
    release(docs.sparkSession)
    shared = materialised(_shared(_prefixes(texts, common, shingle, similarity), similarity))
    release(docs.sparkSession)
    # SimHash links, and two pairs of each row in the lists: large groups are linked by as many pairs as rows, and only pairs across groups remain.
    first = _linked(keyed, RADIUS).unionByName(_spanning(shared, similarity)).distinct()
    near = _verified(first, sketches, texts, similarity, shingle)
    labels = components(near).select(F.col("node").alias("key"), F.col("root").alias("label"))
    named = shared.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rest = _verified(_pairs(named.join(mixed, "token", "left_semi"), similarity), sketches, texts, similarity, shingle)
    groups = components(near.unionByName(rest)).withColumnRenamed("node", "key")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    member = first.join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named_keys = member.select("key", "root").join(lowest, "root").select("key", "component_id")
    return keyed.join(named_keys, "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but one of each group, as drop_near_duplicates does."""
    return keep_least(docs, materialised(near_copies(docs, **options)))
