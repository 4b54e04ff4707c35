"""A raw event log as it arrives: events into one table, rejected rows into another, and replay in spans."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sessora import schemas as S
from sessora.sources.batches import BatchTable, read_batches
from sessora.sources.events import REJECTS, split_events
from sessora.streaming.scoring import _start


def stream_split_events(
    rows: DataFrame, path: str, checkpoint: str, *, run: str, available_now: bool = False
) -> StreamingQuery:
    """Raw rows of a stream to the tables of events and of rejects below ``path``, under one checkpoint.

    Every row goes to one of the two. A batch that is run again replaces itself in both; readers of
    either see whole batches only.
    """
    spark = rows.sparkSession
    accepted, rejected = (BatchTable(spark, f"{path}/{t}", run, fan_out=None) for t in ("events", "rejects"))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both parts come from one read of the input
        try:
            events, rejects = split_events(batch)
            accepted.write(events, number)
            rejected.write(rejects, number)
        finally:
            batch.unpersist()

    return _start(rows.writeStream.foreachBatch(write), checkpoint, available_now)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/events", S.NETWORK_EVENTS).drop("run")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """event_seq if known, reason, the record as text."""
    return read_batches(spark, f"{path}/rejects", REJECTS).drop("run")


def replayed(
    parts: Iterable[DataFrame], folder: str, start: Callable[[], StreamingQuery]
) -> None:
    """Feed a stream that reads the files of ``folder`` part by part, each a micro-batch of many files.

    ``start`` builds and starts the query on what is there (``available_now``, always with one checkpoint); it
    ends before the next part is written. Each part is written and read by as many tasks as it has partitions.
    """
    for part in parts:
        part.write.mode("append").parquet(folder)
        query = start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
