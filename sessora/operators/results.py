"""Inference results: joining them to sessions and keeping them per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S

_RESULT_COLUMNS = [f.name for f in S.INFERENCE_RESULT.fields]


def attach_results(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Give each response the session of its item.

    A response names its item by sequence number as text. Both sides are unique in it, so
    the join key cannot be hot.
    """
    numbered = items.select(
        F.col("queue_sequence_id").cast("string").alias("request_id"),
        "queue_sequence_id",
        F.coalesce("message.session_id", "session.session_id").alias("session_id"),
    )
    return numbered.join(responses, "request_id")


def inference_session_state(results: DataFrame) -> DataFrame:
    """Latest result, first and last time, and counts per session.

    First and last go by ``arrival_seq``, not by the time values. Aggregates partially
    before the shuffle; also valid on a stream in update mode.
    """
    latest = F.max(F.struct("arrival_seq", *[c for c in _RESULT_COLUMNS if c != "arrival_seq"]))
    first = F.min(F.struct("arrival_seq", "received_wall_time"))
    return (
        results.groupBy("session_id")
        .agg(
            latest.alias("_latest"),
            first.alias("_first"),
            F.count(F.lit(1)).alias("total_result_count"),
            F.count_if("is_attack").alias("attack_result_count"),
        )
        .select(
            "session_id",
            F.struct(*[F.col("_latest")[c].alias(c) for c in _RESULT_COLUMNS]).alias(
                "latest_result"
            ),
            F.col("_first.received_wall_time").alias("first_result_wall_time"),
            F.col("_latest.received_wall_time").alias("last_result_wall_time"),
            "total_result_count",
            "attack_result_count",
        )
    )


def inference_session_count(results: DataFrame) -> DataFrame:
    """How many sessions have a result."""
    return results.agg(F.count_distinct("session_id").alias("session_count"))
