"""Packing documents into fixed-length training sequences.

First-fit decreasing with a tournament tree over the bins' free room, run on its own in each
randomised group of pieces. Documents longer than a sequence are cut at multiples of its length,
so only the last piece of a document is shorter than a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import giving_back, materialised, numbered, renumbered
from .tokens import encoder

END_ID = 2
LENGTH = 4096
#: Tokens that one group holds on average; a group is packed by one task in memory.
GROUP_TOKENS = 1 << 21
PIECES = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class RoomTree:
    """A tournament tree: every node holds the most free room of any bin below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put size into the first bin with that much room; the bin and the room it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        had = most[at]
        leaf, most[at] = at - self.leaves, had - size
        while at > 1:
            at >>= 1
            now = max(most[2 * at], most[2 * at + 1])
            if most[at] == now:
                break
            most[at] = now
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each size. Equal sizes keep their order. Every size must be 1 to capacity."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    if len(rest):
        tree = RoomTree(len(rest), capacity)
        for i, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
            leaf, had = tree.place(size)
            bins[i], offsets[i] = full + leaf, capacity - had
    return bins, offsets


def pieces(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row per piece of each document: its place in the document, its length and the checksum of its ids. Where no_id is true the doc_id is null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, none, ids in zip(batch["doc_id"].to_pylist(), batch["no_id"].to_pylist(), coder.stream(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((doc, none, start, len(piece), zlib.crc32(piece), len(ids)))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    names = [p.split()[0] for p in PIECES.split(", ")]
    kinds = [pa.bool_() if p.endswith("boolean") else pa.int64() for p in PIECES.split(", ")]
    return numbered(docs, "doc_id", text="string").mapInArrow(giving_back(cut), PIECES)


def pack(docs: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `length` ids.

    Every document is its ids followed by end_id; a null or empty text is the end id alone. Repeated
    rows are packed each for itself; a null doc_id stays null. A very long text is encoded whole and cut
    into pieces of `length`. Pieces of equal length are placed in order of doc_id and place. Other
    columns, whatever their names, are ignored. An empty table gives no rows. Groups are drawn at random by row, so one document id or text that is
    repeated many times is spread over all groups; their number follows the count of tokens.
    """
    cut = materialised(pieces(docs, vocabulary=vocabulary, end_id=end_id, length=length))
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_tokens))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["no_id", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(np.int64), length)
        return rows[["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    dealt = cut.withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return renumbered(dealt.groupBy("bin_group").applyInPandas(fill, PACKED))
