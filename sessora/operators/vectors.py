"""Feature vectors of messages and session summaries: names and doubles in fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessora import schemas as S


def vector(names: Sequence[str], prefix: str = "") -> Column:
    """Doubles of the named columns, in the given order."""
    return F.array(*[F.col(prefix + name).cast("double") for name in names])


def vector_names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in names])


def message_vector(messages: DataFrame) -> DataFrame:
    """Add ``event_type``, ``names`` and ``values`` to message snapshots."""
    return messages.withColumns(
        {
            "event_type": F.lit(S.MESSAGE_EVENT),
            "names": vector_names(S.MESSAGE_FEATURES),
            "values": vector(S.MESSAGE_FEATURES),
        }
    )


def session_vector(summaries: DataFrame) -> DataFrame:
    """Add ``event_type``, ``names`` and ``values`` to session summaries."""
    return summaries.withColumns(
        {
            "event_type": F.lit(S.SESSION_EVENT),
            "names": vector_names(S.SESSION_FEATURES),
            "values": vector(S.SESSION_FEATURES),
        }
    )


def item_vector(items: DataFrame) -> DataFrame:
    """Add ``event_type``, ``names`` and ``values`` to mixed feature items."""
    is_message = F.col("type") == S.MESSAGE_ITEM
    return items.withColumns(
        {
            "event_type": F.when(is_message, S.MESSAGE_EVENT).otherwise(S.SESSION_EVENT),
            "names": F.when(is_message, vector_names(S.MESSAGE_FEATURES)).otherwise(
                vector_names(S.SESSION_FEATURES)
            ),
            "values": F.when(is_message, vector(S.MESSAGE_FEATURES, "message.")).otherwise(
                vector(S.SESSION_FEATURES, "session.")
            ),
        }
    )


def vector_long(vectors: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per vector entry: ``ids``, ``position`` from 0, ``name``, ``value``."""
    pairs = vectors.select(*ids, F.posexplode(F.arrays_zip("names", "values")))
    return pairs.select(
        *ids,
        F.col("pos").alias("position"),
        F.col("col.names").alias("name"),
        F.col("col.values").alias("value"),
    )
