"""Gap-free item numbers for items that a stream appends, without rereading those numbered before.

A ledger holds the next free number after each batch. A batch is numbered in its own order and shifted by
the ledger's last entry, its items are written, then its entry is committed; readers take only
items of committed batches. A batch that is run again finds either no entry, and replaces its items, or its entry,
and is left alone: numbers have neither gaps nor repeats.

Items of a batch come in ``(mono_us, event_seq)`` order, batches as they arrive. For input in order the
numbers are those of :func:`sessora.operators.items.sequence_items` over everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sessora.operators.items import sequence_items
from sessora.sources.batches import BATCH, BatchTable
from sessora.streaming.scoring import _start

NUMBER = "queue_sequence_id"
#: The one key of a ledger: merges keep its newest entry.
_LEDGER = "ledger"


class NumberedItems:
    """Items at ``path``, numbered as batches of one run arrive."""

    def __init__(self, spark: SparkSession, path: str, run: str) -> None:
        self.spark = spark
        self.items = BatchTable(spark, f"{path}/items", run, fan_out=None)
        self.ledger = BatchTable(spark, f"{path}/ledger", run, [_LEDGER])

    def append(self, items: DataFrame, batch: int) -> None:
        done = self.ledger.newest()
        if done is not None and done >= batch:
            return
        first = self.next_number()
        numbered = sequence_items(items).withColumn(NUMBER, F.col(NUMBER) + (first - 1))
        self.items.write(numbered, batch)
        count = self.spark.read.parquet(f"{self.items.folder}/{BATCH}={batch}").count()  # footers only
        entry = [("items", first + count)]
        self.ledger.write(self.spark.createDataFrame(entry, f"{_LEDGER} string, next long"), batch)

    def next_number(self) -> int:
        paths = self.ledger.paths()
        if not paths:
            return 1
        return self.spark.read.parquet(*paths).agg(F.max_by("next", BATCH)).first()[0]

    def read(self) -> DataFrame | None:
        """All items of committed batches; None before the first."""
        done = self.ledger.newest()
        paths = [] if done is None else self.items.paths(upto=done)
        return self.spark.read.parquet(*paths) if paths else None


def stream_numbered_items(
    items: DataFrame, path: str, checkpoint: str, *, run: str, available_now: bool = False
) -> StreamingQuery:
    """Append a stream's items with their numbers; read them with :meth:`NumberedItems.read`."""
    table = NumberedItems(items.sparkSession, path, run)
    write: Callable[[DataFrame, int], None] = table.append
    return _start(items.writeStream.foreachBatch(write), checkpoint, available_now)
