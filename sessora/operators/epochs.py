"""Removal of sessions: state starts over after each removal or clear.

Control rows are ``type`` (``RemoveSession`` or ``Clear``), ``session_id`` (NULL for a
clear), ``mono_us`` and ``event_seq``, unique in order together with the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S
from sessora.operators.running import running_session_state
from sessora.operators.snapshots import session_snapshots
from sessora.operators.state import ALL_COLUMNS
from sessora.plans.folds import ROWS_PER_CHUNK, Fold, running

EPOCH_KEYS = ("session_id", "removals", "clears")


def session_epochs(
    events: DataFrame,
    controls: DataFrame,
    *,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Events with ``removals`` of their session and ``clears`` of all, before each event.

    ``(session_id, removals, clears)`` names one life of a session. Removals are counted along their
    session, clears along the whole log, both by marks merged in by order, however many there are.
    """
    removals = controls.where(F.col("type") == S.REMOVE_SESSION)
    clears = controls.where(F.col("type") == S.CLEAR)
    merged = _with_marks(events, removals)
    epochs = _count_marks(merged, ["session_id"], "removals", rows_per_chunk)
    return _count_marks(
        _with_marks(epochs, clears), [], "clears", rows_per_chunk, _with_marks(events, clears)
    )


def _with_marks(events: DataFrame, marks: DataFrame) -> DataFrame:
    marked = marks.select("session_id", *S.ORDER, F.lit(True).alias("_mark"))
    return events.withColumn("_mark", F.lit(False)).unionByName(marked, allowMissingColumns=True)


def _count_marks(
    merged: DataFrame,
    keys: Sequence[str],
    name: str,
    rows_per_chunk: int,
    same_rows: DataFrame | None = None,
) -> DataFrame:
    count = Fold(name, "sum", F.when(F.col("_mark"), 1).otherwise(0))
    counted = running(merged, keys, S.ORDER, [count], rows_per_chunk, same_rows)
    counted = counted.withColumn(name, F.col(name).cast("long"))
    return counted.where(~F.col("_mark")).drop("_mark")


def running_state_with_removals(
    events: DataFrame,
    controls: DataFrame,
    columns: Sequence[str] = ALL_COLUMNS,
    *,
    session_zero_quirk: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Session state after every event, starting over after each removal."""
    return running_session_state(
        session_epochs(events, controls, rows_per_chunk=rows_per_chunk),
        columns,
        session_zero_quirk=session_zero_quirk,
        rows_per_chunk=rows_per_chunk,
        keys=EPOCH_KEYS,
        split_rows=events,
    )


def snapshots_with_removals(
    events: DataFrame,
    controls: DataFrame,
    columns: Sequence[str] = ALL_COLUMNS,
    *,
    session_zero_quirk: bool = True,
) -> DataFrame:
    """Final state of the sessions that have events after their last removal.

    Needs no order-aware pass: events at or before the last removal of their session, or
    the last clear, are dropped, and the rest is aggregated.
    """
    at = F.struct(*S.ORDER)
    removals = controls.where(F.col("type") == S.REMOVE_SESSION)
    last_removal = removals.groupBy("session_id").agg(F.max(at).alias("_removed"))
    clears = controls.where(F.col("type") == S.CLEAR)
    last_clear = clears.agg(F.max(at)).scalar()
    alive = (
        events.join(last_removal, "session_id", "left")
        .where(F.col("_removed").isNull() | (at > F.col("_removed")))
        .where(last_clear.isNull() | (at > last_clear))
        .drop("_removed")
    )
    return session_snapshots(alive, columns, session_zero_quirk=session_zero_quirk)
