"""Column functions: event kinds and time arithmetic."""

from sessora.functions.kinds import (
    is_close,
    is_error,
    is_message,
    is_recv,
    is_send,
    is_start,
)
from sessora.functions.times import (
    duration_ms,
    elapsed_whole_ms,
    epoch_micros,
    epoch_millis,
    epoch_seconds,
    iso_utc,
)

__all__ = [
    "duration_ms",
    "elapsed_whole_ms",
    "epoch_micros",
    "epoch_millis",
    "epoch_seconds",
    "is_close",
    "is_error",
    "is_message",
    "is_recv",
    "is_send",
    "is_start",
    "iso_utc",
]
