"""State as of every event: running forms of the session features.

All operators take normalized events and fold each session in
``(mono_us, event_seq)`` order. A session of any size is cut into chunks, see
:mod:`sessora.plans.folds`; ``rows_per_chunk=None`` turns that off.

Filter on ``session_id`` before or after as you like, Spark moves it to the
scan. Filter on ``type`` only afterwards: every kind takes part in the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S
from sessora.functions import duration_ms, is_close, is_message
from sessora.operators.state import ALL_COLUMNS, fold, needed_folds, read_columns
from sessora.plans.folds import ROWS_PER_CHUNK, final, running

KEYS = ("session_id",)


def running_session_state(
    events: DataFrame,
    columns: Sequence[str] = ALL_COLUMNS,
    *,
    session_zero_quirk: bool = True,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    keys: Sequence[str] = KEYS,
    keep: Sequence[str] = (),
    split_rows: DataFrame | None = None,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Session state after every event, one row per event.

    ``columns`` picks state columns, ``keep`` carries event columns along. ``keys`` may hold
    more than the session id, as in :func:`sessora.operators.epochs.session_epochs`; then
    ``split_rows`` should be the plain event log, so that sizing sessions stays a cheap scan.

    ``kept`` is what :func:`kept_state` kept of all earlier events: then ``events`` are those since, and a day
    costs that day and one row for each session.
    """
    folded = running(
        events,
        keys,
        S.ORDER,
        needed_folds(columns),
        rows_per_chunk,
        split_keys=None if split_rows is None else KEYS,
        split_rows=split_rows,
        seed=kept,
    )
    taken = {*keys, *S.ORDER, "type"}
    passed = [name for name in keep if name not in taken]
    return folded.select(
        *S.ORDER, "type", *keys, *passed, *read_columns(columns, session_zero_quirk)
    )


def kept_state(
    events: DataFrame, kept: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """What :func:`running_session_state` needs of these events to go on after them, one row per session.

    With ``kept`` (an earlier result, of all events before these) over those too. Store it; it is no snapshot:
    read one with :func:`sessora.operators.snapshots.snapshots_of_kept`.
    """
    folds = needed_folds(ALL_COLUMNS)
    return final(events, keys, S.ORDER, folds, seed=kept)


def message_snapshots(
    events: DataFrame,
    *,
    session_zero_quirk: bool = True,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per parsed packet with its session's totals as of that packet."""
    columns = (
        "socket_handle",
        "logic_worker_id",
        "last_event_wall_time",
        "request_count",
        "connection_duration_ms",
        "bytes_received_total",
        "bytes_sent_total",
        "error_count",
    )
    # at a message the packet fields are the event's own, and the gap needs only the
    # message before it, so the carried-forward folds are left out
    folds = [*needed_folds(columns), fold("_earlier_message")]
    folded = running(events, KEYS, S.ORDER, folds, rows_per_chunk).where(is_message())
    state = {c: column for c, column in zip(columns, read_columns(columns, session_zero_quirk))}
    return folded.select(
        *S.ORDER,
        "session_id",
        state["socket_handle"],
        state["logic_worker_id"],
        state["last_event_wall_time"].alias("message_wall_time"),
        state["request_count"].alias("request_index"),
        "packet_id",
        "packet_size",
        "payload_size",
        state["connection_duration_ms"],
        _gap().alias("message_interval_ms"),
        state["bytes_received_total"],
        state["bytes_sent_total"],
        state["error_count"].alias("error_count_total"),
    )


def session_summaries(
    events: DataFrame,
    *,
    session_zero_quirk: bool = True,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """One row per close event with the whole session state at that point."""
    state = running_session_state(
        events, session_zero_quirk=session_zero_quirk, rows_per_chunk=rows_per_chunk
    )
    return state.where(is_close()).drop("type")


def message_interval(
    events: DataFrame, *, rows_per_chunk: int | None = ROWS_PER_CHUNK
) -> DataFrame:
    """Gap to the previous message of the session, 0 for the first; one row per message."""
    messages = _messages(events)
    folds = [fold("_earlier_message")]
    folded = running(messages, KEYS, S.ORDER, folds, rows_per_chunk)
    return folded.select(*S.ORDER, "session_id", _gap().alias("message_interval_ms"))


def request_index(
    events: DataFrame, *, rows_per_chunk: int | None = ROWS_PER_CHUNK
) -> DataFrame:
    """1-based number of each message in its session."""
    messages = _messages(events)
    folded = running(messages, KEYS, S.ORDER, [fold("_messages")], rows_per_chunk)
    return folded.select(
        *S.ORDER, "session_id", F.col("_messages").cast("long").alias("request_index")
    )


def _messages(events: DataFrame) -> DataFrame:
    # both message-only features read nothing but other messages, so here the
    # kind may be filtered first, down to the scan
    return events.where(is_message()).select(*S.ORDER, "session_id", "type")


def _gap():
    return F.coalesce(duration_ms(F.col("_earlier_message"), F.col("mono_us")), F.lit(0.0))


def _feature(events: DataFrame, columns: Sequence[str], options: dict) -> DataFrame:
    return running_session_state(events, columns, **options)


def running_byte_totals(events: DataFrame, **options) -> DataFrame:
    """Received and sent bytes and counts as of each event."""
    columns = ("bytes_received_total", "bytes_sent_total", "recv_event_count", "send_event_count")
    return _feature(events, columns, options)


def running_error_count(events: DataFrame, **options) -> DataFrame:
    """Errors as of each event."""
    return _feature(events, ("error_count",), options)


def running_interval_avg(events: DataFrame, **options) -> DataFrame:
    """Mean gap between messages as of each event, 0 below two messages."""
    return _feature(events, ("avg_message_interval_ms",), options)


def carry_forward_last(events: DataFrame, **options) -> DataFrame:
    """Last packet id and sizes, last error code and text, as of each event."""
    columns = (
        "last_packet_id",
        "last_packet_size",
        "last_payload_size",
        "last_error_code",
        "last_error_message",
    )
    return _feature(events, columns, options)


def connection_duration(events: DataFrame, **options) -> DataFrame:
    """Milliseconds since the session's latest start, as of each event."""
    return _feature(events, ("connection_duration_ms",), options)


def lifecycle_flags(events: DataFrame, **options) -> DataFrame:
    """Started and closed flags and the close time, as of each event."""
    return _feature(events, ("is_started", "is_closed", "connection_close_wall_time"), options)
