"""Readers of the network event log, in batch and as a stream.

A row that is no event never becomes one: text that is not JSON or does not fit the schema, ids of
2 ** 63 and above, and rows without a place in the order are rejected, with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sessora import schemas as S

_CORRUPT = "_corrupt_record"
#: Unsigned in the log; read wide, so that a large one can be told from a missing one.
_IDS = ("session_id", "socket_handle")
_ROWS = T.StructType(
    [
        T.StructField(f.name, T.DecimalType(20, 0) if f.name in _IDS else f.dataType)
        for f in S.NETWORK_EVENTS.fields
    ]
    + [T.StructField(_CORRUPT, T.StringType())]
)

REJECTS = T.StructType(
    [
        T.StructField("event_seq", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record", T.StringType()),
    ]
)


def scan_event_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All rows of the log, good or not, with the fixed schema; nothing is inferred."""
    return spark.read.format(fmt).schema(_ROWS).load(path)


def stream_event_rows(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    *,
    max_files_per_trigger: int | None = 1000,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """All rows as they arrive; the limits bound one micro-batch.

    Spark takes one of the two limits: the byte limit if given, else the file limit.
    """
    reader = spark.readStream.format(fmt).schema(_ROWS)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    elif max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def _reason() -> Column:
    """Why a row is rejected, NULL for an event."""
    reason = F.when(F.col(_CORRUPT).isNotNull(), "corrupt")
    for name in _IDS:
        fits = F.col(name).between(-(1 << 63), (1 << 63) - 1)
        reason = reason.when(~fits, f"{name} too large")
    for name in S.ORDER:
        reason = reason.when(F.col(name).isNull(), f"no {name}")
    return reason


def split_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the schema of the log, and rejected rows as (event_seq, reason, record)."""
    marked = rows.withColumn("_reason", _reason())
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.NETWORK_EVENTS.fields]
    record = F.coalesce(_CORRUPT, F.to_json(F.struct(*S.NETWORK_EVENTS.fieldNames())))
    rejected = marked.where(F.col("_reason").isNotNull())
    return (
        marked.where(F.col("_reason").isNull()).select(*columns),
        rejected.select("event_seq", F.col("_reason").alias("reason"), record.alias("record")),
    )


def scan_network_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The events of a log."""
    return split_events(scan_event_rows(spark, path, fmt))[0]


def scan_rejects(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What of a log is no event: event_seq if known, reason, the record as text."""
    return split_events(scan_event_rows(spark, path, fmt))[1]


def stream_network_events(spark: SparkSession, path: str, fmt: str = "parquet", **limits) -> DataFrame:
    """The events as they arrive; limits as in :func:`stream_event_rows`."""
    return split_events(stream_event_rows(spark, path, fmt, **limits))[0]
