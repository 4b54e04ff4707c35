"""Feature items from a live event stream.

State is kept per session in the state store. A ``RemoveSession`` row deletes it, after a ``Clear`` a
session starts over, and with ``idle_ms`` a session without events for that long is dropped; by
default nothing expires. Within a micro-batch a session's events are applied in
``(mono_us, event_seq)`` order, across micro-batches as they come, so the result equals the batch operators
exactly when the input arrives in order. A late message can have a negative interval, which the
payload rules then reject.

The rules are those of the batch operators, the folds of :mod:`sessora.operators.state`; see
:mod:`sessora.streaming.folds` for how a stream evaluates them. A bucket's share of one micro-batch is
folded in one task, so the limits of the source (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``) bound what a busy
session can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessora import schemas as S
from sessora.functions import is_close, is_message
from sessora.operators.items import items_from_state
from sessora.operators.state import ALL_COLUMNS, needed_folds, read_columns
from sessora.streaming.folds import BUCKETS, stream_running

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of an event that its state shows as they are.
_OWN = ("wall_time", "socket_handle", "logic_worker_id")


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state in RocksDB: on disk, beyond what the JVM's memory holds."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_session_state(
    events: DataFrame,
    *,
    session_zero_quirk: bool = True,
    clears: DataFrame | None = None,
    buckets: int | None = BUCKETS,
    idle_ms: int | None = None,
) -> DataFrame:
    """Session state at each emitting event of a stream, as ``running_session_state`` has it.

    ``events`` are normalized and may hold ``RemoveSession`` rows.

    A clear concerns all sessions, so clears come as a table of their own (``mono_us``,
    ``event_seq``), one row for each command given. Each event knows how many came before it, each
    session how many it has seen. A ``Clear`` among the events fails the stream.

    ``idle_ms`` (processing time) drops sessions without events for that long; one that comes back starts anew.
    Timers run with every micro-batch; a running trigger makes batches without data for them, so
    ``processAllAvailable`` does not return unless ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """
    misplaced = F.raise_error(F.lit("a Clear belongs into the table of clears"))
    events = events.withColumn("type", F.when(F.col("type") == S.CLEAR, misplaced).otherwise(F.col("type")))
    before = None
    if clears is not None:
        given = clears.agg(F.collect_list(F.struct(*S.ORDER))).scalar()
        events = events.withColumn("_given", given)
        before = F.size(F.filter("_given", lambda clear: clear < F.struct(*S.ORDER)))
    folded = stream_running(
        events,
        "session_id",
        S.ORDER,
        needed_folds(ALL_COLUMNS),
        emit=is_message() | is_close(),
        removed=F.col("type") == S.REMOVE_SESSION,
        keep=("type", *_OWN),
        clears=before,
        buckets=buckets,
        idle_ms=idle_ms,
    )
    state = folded.withColumn("_event", F.struct("mono_us", *_OWN))
    return state.select(*S.ORDER, "type", "session_id", *read_columns(ALL_COLUMNS, session_zero_quirk))


def stream_feature_items(events: DataFrame, **options) -> DataFrame:
    """Items as in :func:`sessora.operators.items.items_from_events`, from a stream.

    Options as in :func:`stream_session_state`. A stream has no global item number; items get theirs
    as they are appended (:mod:`sessora.streaming.numbering`).
    """
    return items_from_state(stream_session_state(events, **options))
