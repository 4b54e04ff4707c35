"""Outcome of decoded packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# --- fixed values: packet outcomes ---
UNKNOWN_ID = "unknown_id"
MALFORMED = "malformed"
TRAILING_BYTES = "trailing_bytes"
OK = "ok"


def packet_outcome(packets: DataFrame, known_ids: Sequence[int]) -> DataFrame:
    """Classify each packet and say whether it makes the connection close.

    An unknown id is reported and the connection stays open; a packet that does not decode,
    or leaves bytes over, closes it. The id is looked at first, then the decoding.
    """
    outcome = (
        F.when(~F.coalesce(F.col("packet_id").isin(*known_ids), F.lit(False)), UNKNOWN_ID)
        .when(~F.coalesce(F.col("decode_ok"), F.lit(False)), MALFORMED)
        .when(F.coalesce(F.col("remaining_bytes"), F.lit(0)) != 0, TRAILING_BYTES)
        .otherwise(OK)
    )
    return packets.withColumn("outcome", outcome).withColumn(
        "closes_connection", F.col("outcome").isin(MALFORMED, TRAILING_BYTES)
    )
