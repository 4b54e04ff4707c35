"""Row-wise operators on the event log; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S
from sessora.functions import is_close, is_message


def normalize_events(events: DataFrame) -> DataFrame:
    """Fill the defaults of an event's optional fields."""
    return events.fillna({k: v for k, v in S.EVENT_DEFAULTS.items() if k in events.columns})


def route_events(events: DataFrame) -> DataFrame:
    """Tag each event with what it causes.

    ``counts``: updates a counter or flag; ``emits_message`` / ``emits_summary``: yields an
    item; ``ignored``: an unknown kind, which only touches the session's common fields.
    """
    counts = F.col("type").isin(*S.EVENT_KINDS)
    return events.withColumns(
        {
            "counts": counts,
            "emits_message": is_message(),
            "emits_summary": is_close(),
            "ignored": ~counts,
        }
    )


def message_events(events: DataFrame) -> DataFrame:
    """Events that yield a message snapshot."""
    return events.where(is_message())


def close_events(events: DataFrame) -> DataFrame:
    """Events that yield a session summary."""
    return events.where(is_close())


def emitting_events(events: DataFrame) -> DataFrame:
    """Events that yield a feature item of either kind."""
    return events.where(is_message() | is_close())
