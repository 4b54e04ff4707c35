"""Session state, defined once and used in two forms.

:data:`COLUMNS` says which folds (see :mod:`sessora.plans.folds`) each state
column needs and how it is read from them. The running operators evaluate the
folds as of every event; the snapshot operators evaluate them over the whole
session. Asking for a few columns plans only their folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from sessora import schemas as S
from sessora.functions import (
    duration_ms,
    is_close,
    is_error,
    is_message,
    is_recv,
    is_send,
    is_start,
)
from sessora.plans.folds import EVERY_ROW, Fold, Where


# --- which rows a fold reads -------------------------------------------------


def _start() -> Where:
    return Where("start", is_start())


def _close() -> Where:
    return Where("close", is_close())


def _lifecycle() -> Where:
    return Where("lifecycle", F.col("type").isin(S.SESSION_STARTED, S.SESSION_CLOSED))


def _recv() -> Where:
    return Where("recv", is_recv())


def _send() -> Where:
    return Where("send", is_send())


def _message() -> Where:
    return Where("message", is_message())


def _error() -> Where:
    return Where("error", is_error())


def _sets(name: str, floor: int) -> Where:
    """Messages always set a packet field; an error only where it carries one."""
    return Where(name, is_message() | (is_error() & (F.col(name) > floor)))


# --- folds: kind, value, rows; built only when asked for -------------------------

_FOLDS: dict[str, tuple[str, Callable[[], Column], Callable[[], Where]]] = {
    "_event": (
        "current",
        lambda: F.struct("mono_us", "wall_time", "socket_handle", "logic_worker_id"),
        lambda: EVERY_ROW,
    ),
    "_first_us": ("first", lambda: F.col("mono_us"), lambda: EVERY_ROW),
    "_first_wall": ("first", lambda: F.col("wall_time"), lambda: EVERY_ROW),
    "_start_us": ("last", lambda: F.col("mono_us"), _start),
    "_start_wall": ("last", lambda: F.col("wall_time"), _start),
    "_closed": ("last", is_close, _lifecycle),
    "_close_wall": ("last", lambda: F.col("wall_time"), _close),
    "_recv_count": ("sum", lambda: F.lit(1), _recv),
    "_recv_bytes": ("sum", lambda: F.col("bytes_transferred"), _recv),
    "_send_count": ("sum", lambda: F.lit(1), _send),
    "_send_bytes": ("sum", lambda: F.col("bytes_transferred"), _send),
    "_messages": ("sum", lambda: F.lit(1), _message),
    "_errors": ("sum", lambda: F.lit(1), _error),
    "_first_message": ("first", lambda: F.col("mono_us"), _message),
    "_last_message": ("last", lambda: F.col("mono_us"), _message),
    "_message": ("gap", lambda: F.col("mono_us"), _message),
    "_earlier_message": ("previous", lambda: F.col("mono_us"), _message),
    "_packet_id": ("last", lambda: F.col("packet_id"), lambda: _sets("packet_id", -1)),
    "_packet_size": ("last", lambda: F.col("packet_size"), lambda: _sets("packet_size", 0)),
    "_payload_size": ("last", lambda: F.col("payload_size"), lambda: _sets("payload_size", 0)),
    "_error_code": ("last", lambda: F.col("error_code"), _error),
    "_error_text": ("last", lambda: F.col("error_message"), _error),
}


def fold(name: str) -> Fold:
    """A fold of the session state by name."""
    kind, value, where = _FOLDS[name]
    return Fold(name, kind, value(), where())


@dataclass(frozen=True)
class StateColumn:
    needs: tuple[str, ...]
    read: Callable[[bool], Column]


def _average() -> Column:
    # gaps between messages add up to last minus first
    gaps = F.col("_messages") - 1
    return F.when(
        gaps > 0, duration_ms(F.col("_first_message"), F.col("_last_message")) / gaps
    ).otherwise(F.lit(0.0))


def _or(name: str, default: object) -> Callable[[bool], Column]:
    return lambda quirk: F.coalesce(F.col(name), F.lit(default))


def _plain(name: str) -> Callable[[bool], Column]:
    return lambda quirk: F.col(name)


def _total(name: str) -> Callable[[bool], Column]:
    return lambda quirk: F.col(name).cast("long")


def _restarting_zero(quirk: bool, in_zero: Column, otherwise: Column) -> Column:
    """Session 0 counts as new on every event, so its start is always the event at hand."""
    return F.when(F.col("session_id") == 0, in_zero).otherwise(otherwise) if quirk else otherwise


def _start_wall_time(quirk: bool) -> Column:
    start = F.coalesce("_start_wall", "_first_wall")
    return _restarting_zero(quirk, F.col("_event.wall_time"), start)


def _duration(quirk: bool) -> Column:
    start = F.coalesce("_start_us", "_first_us")
    return _restarting_zero(quirk, F.lit(0.0), duration_ms(start, F.col("_event.mono_us")))


def _last_interval(quirk: bool) -> Column:
    return F.coalesce(F.col("_message_gap") / F.lit(1000.0), F.lit(0.0))


COLUMNS: dict[str, StateColumn] = {
    "socket_handle": StateColumn(("_event",), _plain("_event.socket_handle")),
    "logic_worker_id": StateColumn(("_event",), _plain("_event.logic_worker_id")),
    "is_started": StateColumn(("_start_us",), lambda quirk: F.col("_start_us").isNotNull()),
    "is_closed": StateColumn(("_closed",), _or("_closed", False)),
    "connection_start_wall_time": StateColumn(
        ("_start_wall", "_first_wall", "_event"), _start_wall_time
    ),
    "last_event_wall_time": StateColumn(("_event",), _plain("_event.wall_time")),
    "connection_close_wall_time": StateColumn(("_close_wall",), _plain("_close_wall")),
    "connection_duration_ms": StateColumn(("_start_us", "_first_us", "_event"), _duration),
    "bytes_received_total": StateColumn(("_recv_bytes",), _total("_recv_bytes")),
    "bytes_sent_total": StateColumn(("_send_bytes",), _total("_send_bytes")),
    "recv_event_count": StateColumn(("_recv_count",), _total("_recv_count")),
    "send_event_count": StateColumn(("_send_count",), _total("_send_count")),
    "request_count": StateColumn(("_messages",), _total("_messages")),
    "error_count": StateColumn(("_errors",), _total("_errors")),
    "last_message_interval_ms": StateColumn(("_message",), _last_interval),
    "avg_message_interval_ms": StateColumn(
        ("_messages", "_first_message", "_last_message"), lambda quirk: _average()
    ),
    "last_packet_id": StateColumn(("_packet_id",), _or("_packet_id", -1)),
    "last_packet_size": StateColumn(("_packet_size",), _or("_packet_size", 0)),
    "last_payload_size": StateColumn(("_payload_size",), _or("_payload_size", 0)),
    "last_error_code": StateColumn(("_error_code",), _or("_error_code", 0)),
    "last_error_message": StateColumn(("_error_text",), _or("_error_text", "")),
}

ALL_COLUMNS = tuple(COLUMNS)


def needed_folds(columns: Iterable[str]) -> list[Fold]:
    """The folds that ``columns`` read, each once."""
    wanted = {name for column in columns for name in COLUMNS[column].needs}
    return [fold(name) for name in _FOLDS if name in wanted]


def read_columns(columns: Iterable[str], session_zero_quirk: bool) -> list[Column]:
    """State columns read from evaluated folds, under their own names."""
    types = {field.name: field.dataType for field in S.SESSION_STATE.fields}
    return [
        COLUMNS[column].read(session_zero_quirk).cast(types[column]).alias(column)
        for column in columns
    ]
