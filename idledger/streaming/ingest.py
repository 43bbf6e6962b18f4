"""Continuous ingest: micro-batches into a store, and row-exact statuses from keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import DUPLICATE, INSERTED, KEY, keyed
from ..store import HistoryStore


def ingest(stream: DataFrame, store: HistoryStore, checkpoint: str, *, name: str = "ingest", available_now: bool = False, interval: str | None = None, scrub: bool = False, statuses: str | None = None) -> StreamingQuery:
    """Add every micro-batch of a stream (message_id, server_id, seq) to a store.

    A micro-batch is committed under its number, so one that is run again after a failure changes
    nothing. Rollover happens between micro-batches. The source's own limits hold back the stream. With
    `scrub`, a sample of the store is checked between micro-batches as often as the store's options say.
    `statuses` is a folder for the status of every row, a part for each micro-batch, which a repeated one
    replaces: exact, with set operations alone, where row_statuses() calls Python for every key.
    """

    def commit(batch: DataFrame, number: int) -> None:
        added = store.add_batch(batch, batch_id=f"{name}-{number}")
        if statuses:
            added.select("seq", "message_id", "status").write.mode("overwrite").parquet(f"{statuses}/batch={number}")
        if scrub:
            store.scrub_if_due()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def row_statuses(stream: DataFrame) -> DataFrame:
    """(seq, message_id, status) of every row of a stream (seq, message_id), exact across micro-batches.

    The state holds one flag per key. Within a micro-batch the least seq of a key comes first.
    """

    def decide(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
        status = pd.Series(DUPLICATE, index=rows.index)
        if not state.exists:
            status.iloc[0] = INSERTED
            state.update((True,))
        yield pd.DataFrame({"seq": rows["seq"], "message_id": rows["message_id"], "status": status})

    grouped = keyed(stream.select("seq", "message_id"), "message_id").groupBy(*KEY)
    return grouped.applyInPandasWithState(decide, "seq long, message_id string, status string", "stored boolean", "append", GroupStateTimeout.NoTimeout)


def keep_first_stream(stream: DataFrame, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key that a stream brings; with an event time and a span, state older than that is dropped."""
    rows = keyed(stream, "message_id")
    if event_time and within:
        return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(KEY)
    return rows.dropDuplicates(KEY)
