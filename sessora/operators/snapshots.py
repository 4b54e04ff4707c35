"""Current state per session: final forms of the session features.

All are one partial-plus-final aggregation per session, so a session of any size
reaches its final task as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S
from sessora.operators.running import message_snapshots
from sessora.operators.state import ALL_COLUMNS, needed_folds, read_columns
from sessora.plans.folds import final


def session_snapshots(
    events: DataFrame,
    columns: Sequence[str] = ALL_COLUMNS,
    *,
    session_zero_quirk: bool = True,
    keys: Sequence[str] = ("session_id",),
) -> DataFrame:
    """State of every session after its last event."""
    folded = final(events, keys, S.ORDER, needed_folds(columns))
    return folded.select(*keys, *read_columns(columns, session_zero_quirk))


def snapshots_of_kept(
    kept: DataFrame, *, session_zero_quirk: bool = True, keys: Sequence[str] = ("session_id",)
) -> DataFrame:
    """State of every session from what :func:`sessora.operators.running.kept_state` kept."""
    return kept.select(*keys, *read_columns(ALL_COLUMNS, session_zero_quirk))


def recv_totals(events: DataFrame) -> DataFrame:
    return session_snapshots(events, ("recv_event_count", "bytes_received_total"))


def send_totals(events: DataFrame) -> DataFrame:
    return session_snapshots(events, ("send_event_count", "bytes_sent_total"))


def request_totals(events: DataFrame) -> DataFrame:
    columns = ("request_count", "last_packet_id", "last_packet_size", "last_payload_size")
    return session_snapshots(events, columns)


def error_totals(events: DataFrame) -> DataFrame:
    return session_snapshots(events, ("error_count", "last_error_code", "last_error_message"))


def message_interval_avg(events: DataFrame) -> DataFrame:
    """Mean gap between a session's messages, 0 below two."""
    return session_snapshots(events, ("avg_message_interval_ms",))


def session_lifecycle(events: DataFrame, *, session_zero_quirk: bool = True) -> DataFrame:
    columns = (
        "is_started",
        "is_closed",
        "connection_start_wall_time",
        "last_event_wall_time",
        "connection_close_wall_time",
        "connection_duration_ms",
        "socket_handle",
        "logic_worker_id",
    )
    return session_snapshots(events, columns, session_zero_quirk=session_zero_quirk)


def latest_messages(events: DataFrame, **options) -> DataFrame:
    """Newest message snapshot per session; sessions without a message have no row."""
    return newest_message(message_snapshots(events, **options))


def newest_message(messages: DataFrame) -> DataFrame:
    """The row with the highest ``request_index`` of each session of a snapshot table."""
    columns = [c for c in messages.columns if c not in ("session_id", "request_index")]
    newest = F.max(F.struct("request_index", *columns)).alias("m")
    return messages.groupBy("session_id").agg(newest).select("session_id", "m.*")
