"""Token ids in fixed-width bit-packed files.

A file holds consecutive documents in ascending doc_id order:

    magic "IDLTOK2\\0", then as little-endian unsigned 64-bit integers: bits per id, ids per block,
    documents, ids, blocks, documents without a doc_id (they come first); then for each document its doc_id (signed 64-bit) and its first id's
    place in the file; then every block's byte offset in the payload, one more for its end; then the
    payload, each block starting on a byte.

An id takes the fewest bits that hold every id of the vocabulary. A block is unpacked as a whole with
numpy, and the block offsets let a reader unpack only the blocks that a range of ids touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import giving_back, materialised, numbered, renumbered, shared_path, store
from .tokens import encoder

END_ID = 1
BLOCK = 4096
MAGIC = b"IDLTOK2\0"
#: Bytes of text that go to one file on average; a file is written and read by one task in memory.
FILE_BYTES = 16 << 20
#: Ids of a file that are unpacked together when its documents are read in turn.
UNPACKED = 1 << 18


def width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids side by side, lowest bit first, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def encode_file(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK, without_id: int = 0) -> bytes:
    packed = [pack_bits(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)])
    head = np.array([bits, block, len(doc_ids), len(ids), len(packed), without_id], "<u8").tobytes()
    index = np.stack([doc_ids, starts], axis=1).astype("<i8").tobytes() if len(doc_ids) else b""
    return b"".join([MAGIC, head, index, offsets.astype("<u8").tobytes(), *packed])


class TokenFile:
    """A reader over a file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, docs, self.count, blocks, self.without_id = np.frombuffer(data, "<u8", 6, 8).astype(int).tolist()
        table = np.frombuffer(data, "<i8", 2 * docs, 56).reshape(docs, 2)
        self.doc_ids, self.starts = table[:, 0], table[:, 1]
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, 56 + 16 * docs).astype(np.int64)
        self.payload = memoryview(data)[56 + 16 * docs + 8 * (blocks + 1) :]
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("the token file is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start to stop; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        got = [unpack_bits(self.payload[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.count - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]) if i + 1 < len(self.starts) else self.count)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, UNPACKED ids at a time, or one document with more."""
        low, cuts = 0, np.append(self.starts, self.count)
        while low < len(self.starts):
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + UNPACKED, "right")) - 1)
            ids = self.ids(int(cuts[low]), int(cuts[high]))
            at = (cuts[low : high + 1] - cuts[low]).tolist()
            yield from (ids[a:b] for a, b in zip(at, at[1:], strict=False))
            low = high


def write_token_files(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write documents (doc_id, text) as token files in ascending doc_id order; returns a row per file.

    The rows (part, file, documents, ids) are already computed; `part` numbers the files in order. A null
    or empty text is its end id alone; null doc_ids come first; rows of one doc_id are ordered by their
    text's hash, and equal rows by where they were read, so that a row that is repeated many times is
    dealt over several files. A very long text is encoded whole and lies in one file. Other columns are
    ignored. An empty table gives no file.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = numbered(docs.withColumn("text", text), "doc_id", text="string")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    order = [F.desc("no_id"), "doc_id", "text_hash", "row"]
    placed = rows.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, doc_ids, without, sizes, got, part = encoder(vocabulary), [], 0, [], [], None
        bits = width(max(coder.size, end_id + 1))
        kind = np.uint16 if bits <= 16 else np.uint32
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py()
            doc_ids.append(np.array(batch["doc_id"], np.int64))  # a copy: a view would keep the batch with its texts
            without += batch["no_id"].true_count
            for ids in coder.stream(batch["text"]):
                own = np.empty(len(ids) + 1, kind)
                own[:-1], own[-1] = ids, end_id
                got.append(own)
                sizes.append(len(own))
        if part is not None:
            ids = np.concatenate(got)
            got.clear()
            starts = np.cumsum([0, *sizes[:-1]])
            name = f"part-{part:08d}.tok"
            store(f"{folder}/{name}", encode_file(np.concatenate(doc_ids), starts, ids, bits, block, without))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "documents": pa.array([len(sizes)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})

    return materialised(ordered.select("doc_id", "no_id", "text", "part").mapInArrow(giving_back(write), "part long, file string, documents long, ids long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row per file; the running sum of its ids is a table that the documents are joined
    with. Files that it does not list are passed over.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                file = TokenFile(content)
                ends = np.append(file.starts[1:], file.count)
                crc = [zlib.crc32(ids) for ids in file.documents()]
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "doc_id": file.doc_ids, "no_id": np.arange(len(crc)) < file.without_id, "at": file.starts, "n_tokens": ends - file.starts, "ids_crc32": crc})

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    docs = found.select("path", "content").mapInPandas(giving_back(decode), "file string, doc_id long, no_id boolean, at long, n_tokens long, ids_crc32 long")
    return renumbered(docs.join(bases, "file")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    folder = shared_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, **options))
