"""Feature items: the tagged stream of message snapshots and session summaries.

Items keep the order columns ``mono_us`` and ``event_seq`` of their event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessora import schemas as S
from sessora.functions import is_message
from sessora.operators.events import emitting_events
from sessora.operators.running import running_session_state
from sessora.plans.folds import ROWS_PER_CHUNK, Fold, running

#: The table is one group here, and what follows a numbering runs in as many tasks as there are chunks, so that
#: they are small: 10 ** 7 items have 300 chunks, 10 ** 10 have 300,000, and as many split points and carries.
ROWS_PER_NUMBERING_CHUNK = 1 << 15

_MESSAGE_FIELDS = [f.name for f in S.MESSAGE_SNAPSHOT.fields]
_SESSION_FIELDS = [f.name for f in S.SESSION_STATE.fields]

# a message snapshot is the session state right after its packet, under other names
_MESSAGE_FROM_STATE = {
    "message_wall_time": "last_event_wall_time",
    "request_index": "request_count",
    "packet_id": "last_packet_id",
    "packet_size": "last_packet_size",
    "payload_size": "last_payload_size",
    "message_interval_ms": "last_message_interval_ms",
    "error_count_total": "error_count",
}


def feature_items(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """One tagged table of both snapshot kinds; the struct of the other kind is NULL."""
    tagged_messages = messages.select(
        *S.ORDER,
        F.lit(S.MESSAGE_ITEM).alias("type"),
        F.struct(*_MESSAGE_FIELDS).alias("message"),
    )
    tagged_summaries = summaries.select(
        *S.ORDER,
        F.lit(S.SESSION_ITEM).alias("type"),
        F.struct(*_SESSION_FIELDS).alias("session"),
    )
    return tagged_messages.unionByName(tagged_summaries, allowMissingColumns=True)


def items_from_state(state: DataFrame) -> DataFrame:
    """Items from session state at emitting events (columns ``type`` and the state)."""
    message = F.struct(
        *[F.col(_MESSAGE_FROM_STATE.get(name, name)).alias(name) for name in _MESSAGE_FIELDS]
    )
    return state.select(
        *S.ORDER,
        F.when(is_message(), S.MESSAGE_ITEM).otherwise(S.SESSION_ITEM).alias("type"),
        F.when(is_message(), message).alias("message"),
        F.when(~is_message(), F.struct(*_SESSION_FIELDS)).alias("session"),
    )


def items_from_events(
    events: DataFrame,
    *,
    session_zero_quirk: bool = True,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """All items of an event log in one pass; same rows as :func:`feature_items`."""
    state = running_session_state(
        events, session_zero_quirk=session_zero_quirk, rows_per_chunk=rows_per_chunk
    )
    return items_from_state(emitting_events(state))


def sequence_items(
    items: DataFrame,
    positions: DataFrame | None = None,
    *,
    rows_per_chunk: int | None = ROWS_PER_NUMBERING_CHUNK,
) -> DataFrame:
    """Number items from 1 without gaps, in ``(mono_us, event_seq)`` order.

    Every chunk is numbered on its own and shifted by the counts of the chunks before it,
    so no task sees the whole table. ``positions`` may give the same rows in a cheaper
    plan, such as the emitting events; then the counts do not run ``items`` twice.
    """
    one = Fold("queue_sequence_id", "sum", F.lit(1))
    numbered = running(items, [], S.ORDER, [one], rows_per_chunk, same_rows=positions)
    return numbered.withColumn("queue_sequence_id", F.col("queue_sequence_id").cast("long"))


def admit_items(
    items: DataFrame,
    capacity: int,
    bucket: Column,
    *,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Mark the first ``capacity`` items of each bucket as admitted, the rest as dropped.

    ``bucket`` is any column expression, such as an hour. A bucket of any size is counted
    in chunks. Adds ``bucket``, ``bucket_position`` (from 1) and ``admitted``.
    """
    _check_capacity(capacity)
    placed = items.withColumn("bucket", bucket)
    one = Fold("bucket_position", "sum", F.lit(1))
    counted = running(placed, ["bucket"], S.ORDER, [one], rows_per_chunk)
    position = F.col("bucket_position").cast("long")
    return counted.withColumns(
        {"bucket_position": position, "admitted": position <= F.lit(capacity)}
    )


def admission_stats(items: DataFrame, capacity: int, bucket: Column) -> DataFrame:
    """Offered, admitted and dropped items per bucket; counts before the shuffle."""
    _check_capacity(capacity)
    offered = F.count(F.lit(1))
    admitted = F.least(offered, F.lit(capacity)).cast("long")
    return items.groupBy(bucket.alias("bucket")).agg(
        offered.alias("offered"),
        admitted.alias("admitted"),
        (offered - admitted).alias("dropped"),
    )


def fifo_items(items: DataFrame) -> DataFrame:
    """Items in sequence order; a range-partitioned sort."""
    return items.orderBy("queue_sequence_id")


def hour_of(mono_us: str = "mono_us", hours: int = 1) -> Column:
    """Bucket start of an event time, in epoch microseconds."""
    width = F.lit(hours * 3_600_000_000)
    return F.col(mono_us) - F.pmod(F.col(mono_us), width)


def _check_capacity(capacity: int) -> None:
    if capacity <= 0:
        raise ValueError("capacity must be greater than zero")
