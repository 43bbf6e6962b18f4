"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are first reduced to distinct ones. A tile holds the fingerprints with the same
population counts in each of four 16-bit parts. The Hamming distance of two fingerprints is at least
the sum of the differences of those counts, so tiles whose counts differ beyond the radius are never
compared. Other tile pairs are compared in full, with numpy's exclusive-or and bit counts. Large tiles
are cut into chunks, and each task compares one chunk with one other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import SetAside, materialised, numbered, renumbered
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
PARTS, LEVELS = 4, 17
#: Fingerprints in one chunk of a tile.
CHUNK = 4096
#: Cells of one numpy comparison.
CELLS = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t, shingle, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "mark": marks.view(np.int64)})

    return renumbered(numbered(docs, "doc_id", text="string").mapInPandas(sign, "doc_id long, no_id boolean, mark long"))


def link_labels(homes: np.ndarray, others: np.ndarray, radius: int, within: bool) -> np.ndarray:
    """For each of homes and others, the position of one it is linked with, directly or not; its own if none.

    homes are compared with others, and with each other if `within`. Groups of many linked members
    end up with one label each: as many links as members go on, not as many as pairs.
    """
    every = np.concatenate([homes, others])
    label = np.arange(len(every))
    against, shift = (every, 0) if within else (others, len(homes))
    step = max(1, CELLS // max(1, len(against)))
    for low in range(0, len(homes), step):
        close = np.bitwise_count(homes[low : low + step, None] ^ against[None, :]) <= radius
        if within:
            rows = np.arange(min(step, len(homes) - low))
            close[rows, low + rows] = False
        for i in np.flatnonzero(close.any(axis=1)):
            found = np.unique(label[np.append(np.flatnonzero(close[i]) + shift, low + i)])
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    return label


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Steps to the tiles within the radius, one of each opposite pair; not the tile itself."""
    span = range(-radius, radius + 1)
    steps = (d for d in product(span, repeat=PARTS) if sum(map(abs, d)) <= radius)
    return [d for d in steps if d > (0,) * PARTS]


def _tile(counts: list[Column]) -> Column:
    total = F.lit(0)
    for c in counts:
        total = total * LEVELS + c
    return total.cast("int")


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius; `marks` has distinct longs in `mark`."""
    parts = [F.bit_count(F.shiftrightunsigned("mark", 16 * k).bitwiseAND(F.lit(65535))) for k in range(PARTS)]
    own = marks.select("mark", *(p.alias(f"p{k}") for k, p in enumerate(parts)))
    own = own.withColumn("tile", _tile([F.col(f"p{k}") for k in range(PARTS)]))
    sizes = materialised(own.groupBy("tile").agg(F.count("*").alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / CHUNK).cast("int")))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    chunks = F.broadcast(sizes.select("tile", "chunks"))  # at most LEVELS ** PARTS rows
    own = own.join(chunks, "tile").withColumn("chunk", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int"))

    def target(d: tuple[int, ...]) -> Column:
        moved = [F.col(f"p{k}") + F.lit(x) for k, x in enumerate(d)]
        fits = F.lit(True)
        for m, x in zip(moved, d, strict=True):
            fits = fits & m.between(0, LEVELS - 1) if x else fits
        return F.when(fits, _tile(moved))

    sent = own.select("mark", F.col("chunk").alias("theirs"), F.col("chunks").alias("from_chunks"), F.explode(F.array_compact(F.array(*map(target, _neighbours(radius))))).alias("tile")).join(chunks, "tile")
    widest = sent.groupBy("tile").agg(F.max("from_chunks").alias("widest"))
    visits = sent.select("mark", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "theirs")
    inside = own.where("chunk > 0").select("mark", "tile", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), F.col("chunk").alias("theirs"))
    homes = own.join(F.broadcast(widest), "tile", "left").select("mark", "tile", "chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("widest", F.lit(1)), "chunks") - 1)).alias("theirs"))
    rows = homes.withColumn("visits", F.lit(False)).unionByName(visits.unionByName(inside).withColumn("visits", F.lit(True)))
    key = ["tile", "chunk", "theirs"]
    spread = max(marks.sparkSession.sparkContext.defaultParallelism, -(-total * (len(_neighbours(radius)) + 1) // 500_000))
    dealt = rows.repartition(spread, *key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(unit: np.ndarray, mark: np.ndarray, visiting: np.ndarray) -> pd.DataFrame | None:
            homes, others = mark[~visiting], mark[visiting]
            if not len(homes) or len(mark) < 2:
                return None
            every = np.concatenate([homes, others])
            label = link_labels(homes.view(np.uint64), others.view(np.uint64), radius, unit[2] == 0)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": every[moved], "b": every[label[moved]]}) if len(moved) else None

        open_key: np.ndarray | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            keys, mark, visiting = batch[key].to_numpy(), batch["mark"].to_numpy(np.int64), batch["visits"].to_numpy(bool)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if open_key is not None and (keys[a] != open_key).any():
                    out = links(open_key, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                    if out is not None:
                        yield out
                open_key = keys[a]
                held.append((mark[a:b], visiting[a:b]))
        if held:
            out = links(open_key, *map(np.concatenate, zip(*held, strict=True)))
            if out is not None:
                yield out

    return dealt.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles keep repeats. A null
    or empty text has fingerprint zero and is linked like any other. Repeated rows share a fingerprint
    and give a row each. A null doc_id is kept and never chosen; a component of such rows alone has a null
    component_id. Ties do not arise: a component is named by its least doc_id. A very long text is read
    whole, in one pass, its shingles counted in bounded pieces. Other columns, whatever their names, are
    ignored. An empty table gives no rows.

    Work: a tile's chunks meet its own and its neighbours', so beyond CHUNK fingerprints in a tile the
    comparisons grow with the square of its size, and each fingerprint is sent once for each chunk it
    meets. That is the price of an exact comparison by tiles; distinct fingerprints alone count.
    """
    signed = materialised(fingerprints(docs, shingle, seed))
    first = signed.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    first = materialised(first)
    groups = components(near_links(first.select("mark"), radius)).withColumnRenamed("node", "mark")
    member = first.join(groups, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    lowest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = member.select("mark", "root").join(lowest, "root").select("mark", "component_id")
    return signed.join(named, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but one of each group: the row with the smallest doc_id stays.

    Rows that repeat a kept doc_id leave one row, the one with the least text hash. Rows without a
    doc_id stay.
    """
    return keep_least(docs, materialised(near_duplicates(docs, **options)))


def keep_least(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component_id in `marked`, one row each, and those without a doc_id."""
    keep = marked.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    own = SetAside(docs)
    named = own.rows.withColumn("doc_id", own.column("doc_id").cast("long"))
    left = named.join(keep.select("doc_id"), "doc_id", "left_semi")
    twice = keep.where("rows > 1").select("doc_id")
    if not twice.isEmpty():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64(own.column("text")))
        one = left.join(twice, "doc_id", "left_semi").withColumn("row_in_id", F.row_number().over(order)).where("row_in_id = 1").drop("row_in_id")
        left = left.join(twice, "doc_id", "left_anti").unionByName(one)
    return own.restored(left.unionByName(named.where("doc_id is null")))
