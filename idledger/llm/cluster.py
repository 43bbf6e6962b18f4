"""Shared folders, checkpoints and small numeric helpers for the text operators."""

from __future__ import annotations

import ctypes
import gc
import io
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialised, release, shared_dir, shared_path

__all__ = ["SetAside", "WORD_SPACE", "fetch", "give_back", "giving_back", "kept_by_worker", "load", "make_room", "materialised", "numbered", "read", "release", "renumbered", "share", "shared_dir", "shared_path", "store", "unit_interval"]

#: Code points that separate words, as a literal set for trim/translate.
WORD_SPACE = " \t\n\x0b\x0c\r"


def unit_interval(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the given columns alone."""
    h = F.xxhash64(*parts)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What a worker process keeps between tasks.
_KEPT: list[dict] = []


def kept_by_worker() -> dict:
    """A memory that outlives tasks, until another operator needs the room."""
    _KEPT.append({})
    return _KEPT[-1]


def make_room(besides: dict | None = None) -> None:
    """Empty what the worker keeps for other operators, and give the memory back to the system: the executor's limit holds for all its workers."""
    others = [k for k in _KEPT if k and k is not besides]
    for k in others:
        k.clear()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work on a task's batches, after which the worker returns what it freed: it may then wait beside the workers of other tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


_FETCHED: dict[str, Any] = kept_by_worker()


@contextmanager
def _written(path: str):
    """A stream to a file under a name of this attempt's own, which is then renamed: a repeated attempt replaces it with the same bytes."""
    where, base = _file_system(path)
    folder, name = base.rsplit("/", 1)
    where.create_dir(folder, recursive=True)
    own = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        yield out
    where.move(own, base)


def store(path: str, data: bytes) -> None:
    with _written(path) as out:
        out.write(data)


def load(path: str) -> bytes:
    where, base = _file_system(path)
    with where.open_input_stream(base) as f:
        return f.read()


def _file_system(path: str):
    from pyarrow import fs

    uri = path if ":/" in path else f"file://{path}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def share(path: str, value: Any) -> None:
    """Write a large model to the shared folder, compressed: workers read it from there, and no executor's own disk holds copies."""
    with _written(path) as out, zstandard.ZstdCompressor(level=1).stream_writer(out) as packed:
        pickle.dump(value, packed, 5)


def fetch(path: str) -> Any:
    """What share() put there; a worker keeps the last one it read."""
    if path not in _FETCHED:
        make_room()
        where, base = _file_system(path)
        with where.open_input_stream(base) as f, zstandard.ZstdDecompressor().stream_reader(f) as packed:
            _FETCHED[path] = pickle.load(io.BufferedReader(packed, 1 << 20))
    return _FETCHED[path]


def numbered(rows: DataFrame, id_column: str, **columns: str) -> DataFrame:
    """The id as a long without nulls, no_id where it was null, and other columns by their types.

    A column of longs with a null reaches pandas as floats, which hold 53 bits; without nulls ids stay whole.
    """
    key = F.col(id_column).cast("long")
    own = [F.col(c).cast(kind).alias(c) for c, kind in columns.items()]
    return rows.select(F.coalesce(key, F.lit(0).cast("long")).alias(id_column), key.isNull().alias("no_id"), *own)


def renumbered(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """rows of numbered() with their null ids again."""
    return rows.select(*(F.when(~F.col("no_id"), F.col(c)).alias(c) if c == id_column else F.col(c) for c in rows.columns if c != "no_id"))


class SetAside:
    """A table whose columns are called in_0, in_1, ..., so that no name clashes with an operator's own."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.rows = df.toDF(*(f"in_{i}" for i in range(len(self.names))))

    def column(self, name: str) -> Column:
        return F.col(f"in_{self.names.index(name)}")

    def restored(self, df: DataFrame) -> DataFrame:
        """The table's own columns of df, under their names."""
        return df.select([F.col(f"in_{i}").alias(c) for i, c in enumerate(self.names)])
