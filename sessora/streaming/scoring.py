"""Scoring and result state on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sessora.operators.results import inference_session_state
from sessora.operators.scoring import score_constant
from sessora.operators.vectors import item_vector
from sessora.sources.batches import BATCH, FAN_OUT, BatchTable, batch_writer, newest_rows, read_batches
from sessora.sources.results import result_writer
from sessora.streaming.sessions import stream_feature_items

Scorer = Callable[[DataFrame], DataFrame]


def results_of_items(items: DataFrame, scorer: Scorer = score_constant) -> DataFrame:
    """Score items and shape the answers as results.

    The event's place in the log stands for the request number and the arrival order, and
    its wall time for the time of receipt, so a replayed batch gives the same rows.
    """
    scored = scorer(item_vector(items))
    return scored.select(
        F.coalesce("message.session_id", "session.session_id").alias("session_id"),
        F.col("event_seq").alias("arrival_seq"),
        F.coalesce("message.message_wall_time", "session.last_event_wall_time").alias(
            "received_wall_time"
        ),
        F.col("event_seq").cast("string").alias("request_id"),
        "label",
        "is_attack",
        "confidence",
        "model_version",
        F.col("event_type").alias("received_event_type"),
    )


def stream_score(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    run: str,
    scorer: Scorer = score_constant,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Events to items to scores to the results table at ``path``, in one query.

    ``run`` names this checkpoint in the table; a new checkpoint needs a new one.
    """
    results = results_of_items(stream_feature_items(events, **options), scorer)
    writer = results.writeStream.foreachBatch(result_writer(path, run))
    return _start(writer, checkpoint, available_now)


def stream_inference_state(
    results: DataFrame,
    path: str,
    checkpoint: str,
    *,
    run: str,
    available_now: bool = False,
    fan_out: int = FAN_OUT,
) -> StreamingQuery:
    """Keep the per-session result state live.

    A built-in aggregation in update mode: it combines before the shuffle, so a busy
    session costs one row per task and micro-batch. Each micro-batch writes the sessions it
    changed, and batches are merged by session (:mod:`sessora.sources.batches`); read the newest with
    :func:`read_inference_state`. ``run`` names this checkpoint; of two runs, that with the later name is the
    newer one, so begin it with a time.
    """
    state = inference_session_state(results)
    table = BatchTable(results.sparkSession, path, run, ["session_id"], fan_out)
    writer = state.writeStream.outputMode("update").foreachBatch(batch_writer(table))
    return _start(writer, checkpoint, available_now)


def read_inference_state(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest committed state of every session, that of the newest run in which it occurs; None before any.

    Reads a few folders for each level of merged batches, whatever the number of batches.
    """
    written = read_batches(spark, path)
    if written is None:
        return None
    versions = written.withColumn("_version", F.struct("run", BATCH)).drop("run", BATCH)
    return newest_rows(versions, ["session_id"], "_version").drop("_version")


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Append a stream's rows to parquet files, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path)
    return _start(writer, checkpoint, available_now)


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.start()
    # with idle timers Spark would go on with batches without data and never end; the query takes
    # the setting over as it starts
    conf = SparkSession.active().conf
    before = conf.get(_NO_DATA)
    conf.set(_NO_DATA, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(_NO_DATA, before)
