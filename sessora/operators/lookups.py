"""Look up or drop sessions by id.

``ids`` is a sequence or a DataFrame with ``session_id``; NULL ids match nothing, so a row without an
id is never found and never removed. There is one plan, a join without a hint: Spark broadcasts the
ids only below its own size threshold and shuffles otherwise. For a sequence a lookup also filters by
the ids themselves, if they are few, or by their least and greatest; the filter reaches the scan and changes no
result. A table written by :func:`sessora.sources.lookups.write_for_lookups` then skips most of its files.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Ids that a filter names one by one; more are filtered by range.
FEW_IDS = 100


def _matching(table: DataFrame, ids: DataFrame | Sequence[int], how: str) -> DataFrame:
    if not isinstance(ids, DataFrame):
        values = [v for v in ids if v is not None]
        column = pa.table({"session_id": pa.array(values, pa.int64())})
        ids = table.sparkSession.createDataFrame(column)
        if how == "left_semi" and values:
            here = F.col("session_id")
            few = len(values) <= FEW_IDS
            table = table.where(here.isin(*values) if few else here.between(min(values), max(values)))
    known = ids.select("session_id").where(F.col("session_id").isNotNull())
    return table.join(known, "session_id", how)


def lookup_session_snapshots(snapshots: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Snapshots of the given sessions; an unknown id gives no row."""
    return _matching(snapshots, ids, "left_semi")


def lookup_latest_messages(latest: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Latest messages of the given sessions; a session without one gives no row."""
    return _matching(latest, ids, "left_semi")


def lookup_inference(state: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Kept result state of the given sessions."""
    return _matching(state, ids, "left_semi")


def remove_sessions(snapshots: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Snapshots without the given sessions."""
    return _matching(snapshots, ids, "left_anti")
