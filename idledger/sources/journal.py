"""Interchange formats: journal lines, the tombstone file and the Bloom sidecar."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import EPOCH_TICKS, hash_halves, ticks_to_timestamp, timestamp_to_ticks, unsigned, wide

_BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def encode_lines(entries: DataFrame) -> DataFrame:
    """Entries (message_id, server_id, created_at, hash_hi, hash_lo) as journal lines in a column `value`.

    Spark's base64 breaks after 76 characters, which is 57 bytes of text; the breaks are taken out, so that an entry is one line.
    """
    parts = [F.translate(F.base64(F.col(c).cast("binary")), "\r\n", "") for c in ("message_id", "server_id")]
    parts += [timestamp_to_ticks(F.col("created_at")).cast("string"), unsigned(F.col("hash_hi")).cast("string"), unsigned(F.col("hash_lo")).cast("string")]
    return entries.withColumn("value", F.concat_ws("|", *parts))


def decode_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with message_id, server_id, created_at, hash_hi, hash_lo and is_valid.

    A line has five fields, or three in the old form, whose hash is worked out anew. Lines with other
    counts, bad base64, blank ids or numbers that do not parse are not valid; their fields are null.
    """
    f = F.split(F.col(value), "[|]")
    at = lambda i: F.get(F.col("fields"), F.lit(i))
    rows = lines.withColumn("fields", f)
    text = lambda i: F.when(at(i).rlike(_BASE64) & (at(i) != ""), F.unbase64(at(i)).cast("string"))
    rows = rows.withColumns({"m": text(0), "s": text(1), "ticks": at(2).try_cast("decimal(20,0)"), "hi": at(3).try_cast("decimal(20,0)"), "lo": at(4).try_cast("decimal(20,0)")})
    size = F.size("fields")
    top = wide((1 << 64) - 1)
    good = ((size == 3) | ((size == 5) & F.col("hi").between(0, top) & F.col("lo").between(0, top))) & F.col("m").isNotNull() & F.col("s").isNotNull() & F.col("ticks").between(0, 3_155_378_975_999_999_999)
    rows = rows.withColumn("is_valid", F.coalesce(good, F.lit(False)))
    wrapped = lambda c: F.when(c >= wide(1 << 63), c - wide(1 << 64)).otherwise(c).cast("long")
    hi, lo = hash_halves(F.col("m"))
    out = {
        "message_id": F.col("m"),
        "server_id": F.col("s"),
        "created_at": ticks_to_timestamp(F.col("ticks")),
        "hash_hi": F.when(size == 5, wrapped(F.col("hi"))).otherwise(hi),
        "hash_lo": F.when(size == 5, wrapped(F.col("lo"))).otherwise(lo),
    }
    return rows.withColumns({k: F.when(F.col("is_valid"), v) for k, v in out.items()}).drop("fields", "m", "s", "ticks", "hi", "lo")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return decode_lines(spark.read.text(path))


def invalid_count(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count("*").alias("lines"), F.count_if(~F.col("is_valid")).alias("invalid"))


# File marks and versions.
EXPIRED_MARK, EXPIRED_VERSION = b"EXPD", 1
SIDECAR_MARK, SIDECAR_VERSION = 0x4D4F4F4C, 2


def expired_to_bytes(keys: list[tuple[int, int]]) -> bytes:
    """Tombstones (hash_hi, hash_lo; unsigned) as a file: mark, version, records, checksum of the records."""
    body = b"".join(struct.pack("<QQ", hi, lo) for hi, lo in keys)
    return EXPIRED_MARK + struct.pack("<I", EXPIRED_VERSION) + body + struct.pack("<I", zlib.crc32(body))


def expired_from_bytes(data: bytes) -> list[tuple[int, int]]:
    """The tombstones of a file, in the marked form or as bare records; each once, in order."""
    body = data
    if data[:4] == EXPIRED_MARK:
        if len(data) < 12 or struct.unpack_from("<I", data, 4)[0] != EXPIRED_VERSION:
            raise ValueError("expired file: unknown version")
        body = data[8:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("expired file: checksum mismatch")
    if len(body) % 16:
        raise ValueError("expired file: cut short")
    return list(dict.fromkeys(struct.iter_unpack("<QQ", body)))


def read_expired(spark: SparkSession, path: str) -> DataFrame:
    """hash_hi and hash_lo of every tombstone file under a path; files are read by Spark, on the executors."""
    from collections.abc import Iterator

    import pandas as pd

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                keys = [struct.unpack("<qq", struct.pack("<QQ", *k)) for k in expired_from_bytes(content)]
                yield pd.DataFrame(keys, columns=["hash_hi", "hash_lo"], dtype="int64")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(decode, "hash_hi long, hash_lo long").distinct()


@dataclass(frozen=True)
class Sidecar:
    """A Bloom filter's words as a file: a 20-byte header, the words, and the checksum of both."""

    words: tuple[int, ...]
    bit_count: int
    hash_count: int = 7

    def __post_init__(self):
        if len(self.words) * 64 != self.bit_count or not self.words:
            raise ValueError("words: their length must be bit_count / 64")

    def to_bytes(self) -> bytes:
        body = struct.pack(f"<IIIII{len(self.words)}Q", SIDECAR_MARK, SIDECAR_VERSION, self.bit_count, self.hash_count, len(self.words), *self.words)
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def from_bytes(data: bytes) -> Sidecar:
        if len(data) < 20:
            raise ValueError("sidecar: cut short")
        mark, version, bits, hashes, count = struct.unpack_from("<IIIII", data)
        if mark != SIDECAR_MARK or version not in (1, SIDECAR_VERSION):
            raise ValueError("sidecar: unknown mark or version")
        end = 20 + 8 * count
        if len(data) != end + (4 if version == SIDECAR_VERSION else 0):
            raise ValueError("sidecar: wrong length")
        if version == SIDECAR_VERSION and zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("sidecar: checksum mismatch")
        return Sidecar(struct.unpack_from(f"<{count}Q", data, 20), bits, hashes)

    def write(self, path: str) -> None:
        import os
        import uuid

        if not os.path.dirname(path):
            raise ValueError("path: a folder is needed")
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            f.write(self.to_bytes())
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, path)

    @staticmethod
    def read(path: str) -> Sidecar:
        with open(path, "rb") as f:
            return Sidecar.from_bytes(f.read())


def _put(spark_path: str, data: bytes) -> None:
    """Write a file of a shared folder under this attempt's own name, then rename it."""
    import uuid

    from pyarrow import fs

    path = spark_path if ":/" in spark_path else f"file://{spark_path}"
    where, base = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    folder, name = base.rsplit("/", 1)
    where.create_dir(folder, recursive=True)
    own = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        out.write(data)
    where.move(own, base)


def write_sidecars(words: DataFrame, folder: str, bit_count: int, hash_count: int = 7) -> DataFrame:
    """Words (shard_id, word_idx, word) as a sidecar file per shard, written by the executors; a row per file when it is run.

    A shard's words are at most bit_count / 64 and make one file in memory; absent words are zero.
    """
    import numpy as np
    import pandas as pd

    def write(part: pd.DataFrame) -> pd.DataFrame:
        shard, every = int(part["shard_id"].iloc[0]), np.zeros(bit_count // 64, np.int64)
        every[part["word_idx"].to_numpy()] = part["word"].to_numpy(np.int64)
        _put(f"{folder}/shard-{shard:04d}.blm", Sidecar(tuple(every.view(np.uint64).tolist()), bit_count, hash_count).to_bytes())
        return pd.DataFrame({"shard_id": [shard], "words": [int((every != 0).sum())]})

    return words.select("shard_id", "word_idx", "word").groupBy("shard_id").applyInPandas(write, "shard_id int, words long")


def write_expired(keys: DataFrame, folder: str) -> DataFrame:
    """Tombstones (hash_hi, hash_lo) as a file per partition, written by the executors; a row per file when it is run."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, found = None, []
        for batch in batches:
            if len(batch):
                part = int(batch["part"].iloc[0])
                found += zip(*(batch[c].to_numpy(np.int64).view(np.uint64).tolist() for c in ("hash_hi", "hash_lo")), strict=True)
        if part is not None:
            _put(f"{folder}/part-{part:06d}.exp", expired_to_bytes(found))
            yield pd.DataFrame({"part": [part], "keys": [len(found)]})

    return keys.select("hash_hi", "hash_lo", F.spark_partition_id().alias("part")).mapInPandas(write, "part int, keys long")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, word_idx, word) of every sidecar file under a path. A file that does not check out is left out, with trusted false."""
    from collections.abc import Iterator

    import pandas as pd

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    words = [w - (1 << 64) if w >> 63 else w for w in Sidecar.from_bytes(content).words]
                    yield pd.DataFrame({"path": name, "word_idx": range(len(words)), "word": words, "trusted": True})
                except ValueError:
                    yield pd.DataFrame({"path": [name], "word_idx": [0], "word": [0], "trusted": [False]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, word_idx int, word long, trusted boolean")


__all__ = ["EPOCH_TICKS", "Sidecar", "decode_lines", "encode_lines", "expired_from_bytes", "expired_to_bytes", "invalid_count", "read_expired", "read_journal", "read_sidecars"]
