"""Payload files: reading request bodies, logging payloads and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scan_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one JSON object per line, as raw text in ``value``."""
    return spark.read.text(path)


def payload_lines(accepted: DataFrame) -> DataFrame:
    """Each accepted payload as one JSON line, as it was understood."""
    return accepted.select(
        F.coalesce(F.to_json("message_request"), F.to_json("session_request")).alias("value")
    )


def vector_json() -> Column:
    """``{"names": [...], "values": [...]}`` of a vector row."""
    return F.to_json(F.struct("names", "values"))


def vector_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(vector_json().alias("value"))


def write_payload_log(accepted: DataFrame, path: str, mode: str = "append") -> None:
    payload_lines(accepted).write.mode(mode).text(path)


def write_vector_log(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vector_lines(vectors).write.mode(mode).text(path)
