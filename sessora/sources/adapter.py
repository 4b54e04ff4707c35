"""Test convention: network events derived from the driver's ``events`` table.

``props`` holds ``{"k": n}``. The mapping is ours and is chosen so that every
state rule is hit; see FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessora import schemas as S


def adapt_events(raw: DataFrame) -> DataFrame:
    """``events(event_id, ts, user_id, event_type, value, props)`` as network events."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    is_error = F.col("event_type") == "error"
    is_purchase = F.col("event_type") == "purchase"
    kind = (
        F.when(F.col("event_type") == "click", S.RECV_COMPLETED)
        .when(F.col("event_type") == "view", S.SEND_COMPLETED)
        .when(is_purchase, S.PACKET_PARSED)
        .when(is_error, S.PROTOCOL_ERROR)
        .when((F.col("event_type") == "signup") & (F.col("k") < 50), S.SESSION_STARTED)
        .when(F.col("event_type") == "signup", S.SESSION_CLOSED)
    )
    has_id = is_purchase | (is_error & (F.col("k") % 3 != 0))
    has_size = is_purchase | (is_error & (F.col("k") % 2 == 1))
    return raw.withColumn("k", k).select(
        F.col("event_id").alias("event_seq"),
        kind.alias("type"),
        F.col("user_id").alias("session_id"),
        (F.col("user_id") + 1000).alias("socket_handle"),
        (F.col("k") % 4).cast("int").alias("logic_worker_id"),
        ts.alias("wall_time"),
        F.unix_micros(ts).alias("mono_us"),
        F.floor("value").cast("long").alias("bytes_transferred"),
        F.when(has_id, F.col("k")).otherwise(-1).alias("packet_id"),
        F.when(has_size, F.col("k") + 4).otherwise(0).alias("packet_size"),
        F.when(has_size, F.col("k")).otherwise(0).alias("payload_size"),
        F.when(is_error, F.col("k")).otherwise(0).cast("long").alias("error_code"),
        F.when(is_error, F.concat(F.lit("err-"), F.col("k"))).otherwise("").alias("error_message"),
    )


def adapt_packets(raw: DataFrame) -> DataFrame:
    """A decoded packet log for the packet outcome job."""
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.withColumn("k", k).select(
        F.col("event_id").alias("packet_seq"),
        F.col("user_id").alias("session_id"),
        (F.col("k") % 5).alias("packet_id"),
        (F.col("k") % 3 != 0).alias("decode_ok"),
        (F.col("k") % 4).alias("remaining_bytes"),
    )
