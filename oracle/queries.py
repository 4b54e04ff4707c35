"""One Spark query per operator over the driver's tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessora import schemas as S
from sessora.functions import (
    duration_ms,
    elapsed_whole_ms,
    epoch_micros,
    epoch_millis,
    epoch_seconds,
    is_error,
)
from sessora.operators import epochs as P
from sessora.operators import events as E
from sessora.operators import items as I
from sessora.operators import lookups as L
from sessora.operators import packets as K
from sessora.operators import payloads as J
from sessora.operators import results as Z
from sessora.operators import running as R
from sessora.operators import scoring as C
from sessora.operators import snapshots as N
from sessora.operators import vectors as V
from sessora.sources.adapter import adapt_events, adapt_packets
from sessora.sources.results import read_inference_results
from sessora.streaming import ingest as XG
from sessora.streaming import numbering as XN
from sessora.streaming import scoring as XS
from sessora.streaming import sessions as XI

CAPACITY = 3
_BASE_US = 1704067200000000  # 2024-01-01 00:00:00 UTC
_SMALL_CHUNK = 16  # rows; forces many chunks per session on test data

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs ----------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.normalize_events(adapt_events(raw_events(spark, sf_dir)))


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return I.sequence_items(I.items_from_events(log), E.emitting_events(log))


def threshold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message snapshots scored by the threshold rule, as results in event order."""
    scored = _score_by_rule(V.message_vector(R.message_snapshots(events(spark, sf_dir))))
    return scored.select(
        "session_id",
        F.col("event_seq").alias("arrival_seq"),
        F.col("message_wall_time").alias("received_wall_time"),
        F.col("event_seq").cast("string").alias("request_id"),
        *["label", "is_attack", "confidence", "model_version"],
        F.col("event_type").alias("received_event_type"),
    )


def _score_by_rule(vectors: DataFrame) -> DataFrame:
    attack = F.col("error_count_total") >= 3
    return C.score_where(
        vectors,
        attack,
        confidence=F.when(attack, 0.9).otherwise(0.1),
        model_version=C.ThresholdModel.version,
    )


def removal_controls(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and control rows: errors with code 99 become removals, plus one clear."""
    is_removal = is_error() & (F.col("error_code") == 99)
    removals = log.where(is_removal).select(
        F.lit(S.REMOVE_SESSION).alias("type"), "session_id", *S.ORDER
    )
    clear = log.sparkSession.sql(
        "SELECT 'Clear' AS type, CAST(NULL AS BIGINT) AS session_id,"
        " unix_micros(TIMESTAMP '2024-01-15 00:00:00 UTC') AS mono_us,"
        " CAST(-1 AS BIGINT) AS event_seq"
    )
    return log.where(~is_removal), removals.unionByName(clear)


def lookup_ids(snapshots: DataFrame) -> DataFrame:
    """Session ids ending in 3, plus one that matches nothing."""
    ids = snapshots.select("session_id").distinct().where(F.col("session_id") % 10 == 3)
    return ids.unionByName(ids.sparkSession.sql("SELECT CAST(-1 AS BIGINT) AS session_id"))


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads, six in ten of them broken, by sequence number."""
    items = numbered_items(spark, sf_dir)
    text, fault = F.col("value"), F.col("queue_sequence_id") % 10
    value = (
        F.when(fault == 0, F.substring(text, 1, 50))
        .when(fault == 1, F.replace(text, F.lit('"event_type":"'), F.lit('"event_type":"x')))
        .when(fault == 2, F.replace(text, F.lit('"v1"'), F.lit('"v2"')))
        .when(fault == 3, F.replace(text, F.lit('"packet_id"'), F.lit('"packet"')))
        .when(fault == 4, F.replace(text, F.lit('"session_id":'), F.lit('"session_id":-1')))
        .when(fault == 5, F.replace(text, F.lit('"socket_handle":'), F.lit('"socket_handle":0.')))
        .otherwise(text)
    )
    return J.item_payloads(items).withColumn("value", value)


def run_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder.

    Only a local session without one gets a temporary folder, which goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sessora-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/{uuid.uuid4().hex}"


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    XI.use_rocksdb(spark)
    schema = raw_events(spark, sf_dir).schema
    # a path pattern, as a file stream does not take a plain file; it matches this one name alone
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return E.normalize_events(adapt_events(stream))


# --- flat forms --------------------------------------------------------------


def _spread(vectors: DataFrame, keep: str, size: int) -> DataFrame:
    return vectors.select(
        *keep.split(),
        "event_type",
        F.array_join("names", ",").alias("names"),
        *[F.get("values", F.lit(i)).alias(f"v{i}") for i in range(size)],
    )


def _two_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events of two spans, and what is kept of the first, stored as between two jobs."""
    log, half = events(spark, sf_dir), _BASE_US + 14 * 86_400_000_000
    before, after = log.where(F.col("mono_us") <= half), log.where(F.col("mono_us") > half)
    folder = run_folder(spark)
    R.kept_state(before).write.parquet(f"{folder}/kept")
    return before, after, spark.read.parquet(f"{folder}/kept")


def running_state_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span by itself, the second from what the first left."""
    before, after, kept = _two_days(spark, sf_dir)
    return R.running_session_state(before).unionByName(R.running_session_state(after, kept=kept))


def snapshots_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, after, kept = _two_days(spark, sf_dir)
    return N.snapshots_of_kept(R.kept_state(after, kept))


def _flat_items(items: DataFrame) -> DataFrame:
    """Every field of both structs."""
    return items.select(
        *S.ORDER,
        "type",
        *[F.col(f"message.{f}").alias(f"m_{f}") for f in S.MESSAGE_SNAPSHOT.fieldNames()],
        *[F.col(f"session.{f}").alias(f"s_{f}") for f in S.SESSION_STATE.fieldNames()],
    )


def _flat_result_state(state: DataFrame) -> DataFrame:
    return state.select(
        "session_id",
        F.col("latest_result.arrival_seq").alias("latest_arrival_seq"),
        F.col("latest_result.label").alias("latest_label"),
        F.col("latest_result.is_attack").alias("latest_is_attack"),
        F.col("latest_result.confidence").alias("latest_confidence"),
        "first_result_wall_time",
        "last_result_wall_time",
        "total_result_count",
        "attack_result_count",
    )


def _on_events(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(events(spark, sf_dir), **options)


# --- queries -----------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions have results, once every packet has been scored as of its moment."""
    vectors = V.message_vector(R.message_snapshots(events(spark, sf_dir)))
    scored = C.score_constant(vectors)
    results = scored.select(
        "session_id",
        F.col("event_seq").alias("arrival_seq"),
        F.col("message_wall_time").alias("received_wall_time"),
        F.col("event_seq").cast("string").alias("request_id"),
        *["label", "is_attack", "confidence", "model_version"],
        F.col("event_type").alias("received_event_type"),
    )
    return Z.inference_session_state(results).select(
        "session_id",
        "total_result_count",
        "attack_result_count",
        "first_result_wall_time",
        "last_result_wall_time",
        F.col("latest_result.confidence").alias("latest_confidence"),
    )


def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def without(name: str, n: int) -> Column:
        return F.when(F.col("event_seq") % n != 0, F.col(name)).alias(name)

    holes = adapt_events(raw_events(spark, sf_dir)).select(
        "event_seq",
        without("type", 7),
        "session_id",
        without("logic_worker_id", 5),
        without("bytes_transferred", 5),
        without("packet_id", 3),
        without("error_message", 3),
    )
    return E.normalize_events(holes)


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_seq") % 11 == 0, "Heartbeat").otherwise(F.col("type"))
    log = events(spark, sf_dir).select("event_seq", kind.alias("type"))
    return E.route_events(log)


def packet_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = K.packet_outcome(adapt_packets(raw_events(spark, sf_dir)), known_ids=(1, 2))
    return outcomes.select("packet_seq", "session_id", "outcome", "closes_connection")


def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return raw_events(spark, sf_dir).select(
        "event_id",
        epoch_seconds(ts).alias("seconds"),
        epoch_millis(ts).alias("millis"),
        epoch_micros(ts).alias("micros"),
    )


def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_seq",
        elapsed_whole_ms(F.lit(_BASE_US), F.col("mono_us")).alias("ms"),
        elapsed_whole_ms(F.col("mono_us"), F.lit(_BASE_US)).alias("back_ms"),
    )


def removal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.running_state_with_removals(*removal_controls(events(spark, sf_dir)))


def removal_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.snapshots_with_removals(*removal_controls(events(spark, sf_dir)))


def removal_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = P.session_epochs(*removal_controls(events(spark, sf_dir)))
    return epochs.select("event_seq", *P.EPOCH_KEYS)


def lookup_session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return L.lookup_session_snapshots(N.session_snapshots(log), lookup_ids(log))


def lookup_latest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return L.lookup_latest_messages(N.latest_messages(log), lookup_ids(log))


def lookup_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = Z.inference_session_state(threshold_results(spark, sf_dir))
    return _flat_result_state(L.lookup_inference(state, lookup_ids(events(spark, sf_dir))))


def remove_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return L.remove_sessions(N.session_snapshots(log), lookup_ids(log))


def attach_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = numbered_items(spark, sf_dir)
    responses = C.inference_responses(C.score_constant(V.item_vector(items)))
    return Z.attach_results(items, responses).select(
        "request_id", "queue_sequence_id", "session_id", "label", "received_event_type"
    )


def feature_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return _flat_items(I.feature_items(R.message_snapshots(log), R.session_summaries(log)))


def items_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_items(I.items_from_events(events(spark, sf_dir)))


def sequence_items(rows_per_chunk: int = I.ROWS_PER_NUMBERING_CHUNK) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = events(spark, sf_dir)
        numbered = I.sequence_items(
            I.items_from_events(log), E.emitting_events(log), rows_per_chunk=rows_per_chunk
        )
        return numbered.select("event_seq", "type", "queue_sequence_id")

    return query


def admit_items(rows_per_chunk: int = R.ROWS_PER_CHUNK) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        offered = E.emitting_events(events(spark, sf_dir)).select(*S.ORDER)
        admitted = I.admit_items(offered, CAPACITY, I.hour_of(), rows_per_chunk=rows_per_chunk)
        return admitted.select("event_seq", "bucket", "bucket_position", "admitted")

    return query


def sequence_admitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = E.emitting_events(events(spark, sf_dir)).select(*S.ORDER)
    admitted = I.admit_items(offered, CAPACITY, I.hour_of()).where("admitted")
    return I.sequence_items(admitted.select(*S.ORDER)).select("event_seq", "queue_sequence_id")


def admission_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.admission_stats(E.emitting_events(events(spark, sf_dir)), CAPACITY, I.hour_of())


def fifo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = numbered_items(spark, sf_dir).select("queue_sequence_id", "event_seq", "type")
    return I.fifo_items(items)


def message_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read back."""
    payloads = J.message_payloads(numbered_items(spark, sf_dir)).select("value")
    parsed = J.parse_payloads(payloads).select("message_request")
    request = F.col("message_request")
    return parsed.select(
        *[request[c].alias(c) for c in _ENVELOPE],
        *[request["session"][c].alias(c) for c in ("session_id", "socket_handle")],
        request["session"]["logic_worker_id"].cast("int").alias("logic_worker_id"),
        request["message"]["request_index"].alias("request_index"),
        request["message"]["packet_id"].cast("int").alias("packet_id"),
        *_features(request, S.MESSAGE_FEATURES),
    )


def session_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = J.session_payloads(numbered_items(spark, sf_dir)).select("value")
    parsed = J.parse_payloads(payloads).select("session_request")
    request = F.col("session_request")
    session = ("session_id", "is_started", "is_closed", "last_error_code", "last_error_message")
    return parsed.select(
        *[request[c].alias(c) for c in _ENVELOPE],
        *[request["session"][c].alias(c) for c in session],
        *_features(request, S.SESSION_FEATURES),
    )


_ENVELOPE = ("queue_sequence_id", "schema_version", "event_type", "timestamp")


def _features(request: Column, names: tuple[str, ...]) -> list[Column]:
    features = request["features"]
    return [features[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)]


def parse_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = J.parse_payloads(broken_payloads(spark, sf_dir))
    return parsed.select(
        "queue_sequence_id",
        "is_json",
        "event_type",
        F.col("message_request").isNotNull().alias("is_message_request"),
        F.col("session_request").isNotNull().alias("is_session_request"),
    )


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.validate_payloads(J.parse_payloads(broken_payloads(spark, sf_dir)))


def validate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.array_join("errors", ",").alias("errors")
    return _validated(spark, sf_dir).select("queue_sequence_id", errors)


def split_payloads_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.split_payloads(_validated(spark, sf_dir))[0].select("queue_sequence_id")


def split_payloads_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = J.split_payloads(_validated(spark, sf_dir))[1]
    return rejected.select("queue_sequence_id", F.array_join("errors", ",").alias("errors"))


def snapshot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = R.message_snapshots(events(spark, sf_dir)).withColumn(
        "connection_duration_ms", F.col("connection_duration_ms") - 1000
    )
    checked = J.snapshot_errors(snapshots, S.MESSAGE_EVENT)
    return checked.select("event_seq", F.array_join("errors", ",").alias("errors"))


def message_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.message_vector(R.message_snapshots(events(spark, sf_dir)))
    return _spread(vectors, "event_seq", len(S.MESSAGE_FEATURES))


def session_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.session_vector(R.session_summaries(events(spark, sf_dir)))
    return _spread(vectors, "event_seq", len(S.SESSION_FEATURES))


def vector_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.message_vector(R.message_snapshots(events(spark, sf_dir)))
    return V.vector_long(vectors, ["event_seq"])


def _scores(scorer: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = scorer(V.message_vector(R.message_snapshots(events(spark, sf_dir))))
        return scored.select("event_seq", "label", "is_attack", "confidence", "model_version")

    return query


def inference_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inference_responses(C.score_constant(V.item_vector(numbered_items(spark, sf_dir))))


def _stretched_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose confidence grows with the sequence number, past 1."""
    return inference_responses(spark, sf_dir).select(
        "request_id", (F.col("request_id").cast("bigint") / F.lit(1000.0)).alias("confidence")
    )


def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_responses(_stretched_responses(spark, sf_dir))


def invalid_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.invalid_responses(_stretched_responses(spark, sf_dir))


def stream_feature_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark)
    items = XI.stream_feature_items(streamed_events(spark, sf_dir))
    XS.write_stream(items, f"{folder}/out", f"{folder}/cp", available_now=True).awaitTermination()
    return _flat_items(spark.read.schema(items.schema).parquet(f"{folder}/out"))


def stream_session_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark)
    is_removal = is_error() & (F.col("error_code") == 99)
    log = streamed_events(spark, sf_dir).withColumn(
        "type", F.when(is_removal, S.REMOVE_SESSION).otherwise(F.col("type"))
    )
    items = XI.stream_feature_items(log)
    XS.write_stream(items, f"{folder}/out", f"{folder}/cp", available_now=True).awaitTermination()
    return _flat_items(spark.read.schema(items.schema).parquet(f"{folder}/out"))


def _replayed_items(log: DataFrame, spans: list[tuple], **options) -> DataFrame:
    """Items of a stream that takes the events of each span of ``mono_us`` as a micro-batch, in this order."""
    spark = log.sparkSession
    XI.use_rocksdb(spark)
    folder = run_folder(spark)

    def start():
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
        items = XI.stream_feature_items(stream, **options)
        return XS.write_stream(items, f"{folder}/out", f"{folder}/cp", available_now=True)

    spanned = [log.where((F.col("mono_us") > low) & (F.col("mono_us") <= high)) for low, high in spans]
    XG.replayed(spanned, f"{folder}/in", start)
    return _flat_items(spark.read.parquet(f"{folder}/out"))


def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the log arrives first."""
    half = _BASE_US + 14 * 86_400_000_000
    return _replayed_items(events(spark, sf_dir), [(half, float("inf")), (float("-inf"), half)])


def stream_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals in the stream, and a clear in its table, over several micro-batches."""
    log = events(spark, sf_dir)
    controls = removal_controls(log)[1]
    is_removal = is_error() & (F.col("error_code") == 99)
    marked = log.withColumn("type", F.when(is_removal, S.REMOVE_SESSION).otherwise(F.col("type")))
    cuts = [float("-inf"), *log.approxQuantile("mono_us", [1 / 3, 2 / 3], 0.01), float("inf")]
    clears = controls.where(F.col("type") == S.CLEAR)
    return _replayed_items(marked, list(zip(cuts, cuts[1:])), clears=clears)


def stream_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the log, in order, with every session idle for too long between them."""
    half = _BASE_US + 14 * 86_400_000_000
    spans = [(float("-inf"), half), (half, float("inf"))]
    return _replayed_items(events(spark, sf_dir), spans, idle_ms=1)


def stream_numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items numbered as they are appended, over four micro-batches in order."""
    log = events(spark, sf_dir)
    XI.use_rocksdb(spark)
    folder = run_folder(spark)

    def start():
        items = XI.stream_feature_items(spark.readStream.schema(log.schema).parquet(f"{folder}/in"))
        return XN.stream_numbered_items(items, f"{folder}/out", f"{folder}/cp", run="one", available_now=True)

    days = [float("-inf"), *[_BASE_US + d * 86_400_000_000 for d in (7, 14, 21)], float("inf")]
    weeks = [log.where((F.col("mono_us") > low) & (F.col("mono_us") <= high)) for low, high in zip(days, days[1:])]
    XG.replayed(weeks, f"{folder}/in", start)
    return XN.NumberedItems(spark, f"{folder}/out", "one").read().select("event_seq", "type", "queue_sequence_id")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark)
    log = streamed_events(spark, sf_dir)
    XS.stream_score(log, f"{folder}/out", f"{folder}/cp", run="one", available_now=True).awaitTermination()
    return read_inference_results(spark, f"{folder}/out")


def stream_inference_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark)
    results = threshold_results(spark, sf_dir).select(*S.INFERENCE_RESULT.fieldNames())
    results.write.parquet(f"{folder}/results")
    stream = spark.readStream.schema(S.INFERENCE_RESULT).parquet(f"{folder}/results")
    XS.stream_inference_state(
        stream, f"{folder}/out", f"{folder}/cp", run="one", available_now=True
    ).awaitTermination()
    return _flat_result_state(XS.read_inference_state(spark, f"{folder}/out"))


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "normalize_events": normalize_events,
    "route_events": route_events,
    "message_events": lambda s, d: E.message_events(events(s, d)).select(
        "event_seq", "session_id", "packet_id"
    ),
    "close_events": lambda s, d: E.close_events(events(s, d)).select(
        "event_seq", "session_id", "wall_time"
    ),
    "packet_outcome": packet_outcome,
    "duration_ms": lambda s, d: events(s, d).select(
        "event_seq", duration_ms(F.lit(_BASE_US), F.col("mono_us")).alias("ms")
    ),
    "epoch_times": epoch_times,
    "elapsed_whole_ms": elapsed,
    "session_snapshots": _on_events(N.session_snapshots),
    "recv_totals": _on_events(N.recv_totals),
    "send_totals": _on_events(N.send_totals),
    "request_totals": _on_events(N.request_totals),
    "error_totals": _on_events(N.error_totals),
    "message_interval_avg": _on_events(N.message_interval_avg),
    "session_lifecycle": _on_events(N.session_lifecycle),
    "latest_messages": _on_events(N.latest_messages),
    "inference_session_state": lambda s, d: _flat_result_state(
        Z.inference_session_state(threshold_results(s, d))
    ),
    "inference_session_count": lambda s, d: Z.inference_session_count(threshold_results(s, d)),
    "admission_stats": admission_stats,
    "running_session_state": _on_events(R.running_session_state),
    "running_session_state_in_chunks": _on_events(
        R.running_session_state, rows_per_chunk=_SMALL_CHUNK
    ),
    "message_snapshots": _on_events(R.message_snapshots),
    "message_snapshots_in_chunks": _on_events(R.message_snapshots, rows_per_chunk=_SMALL_CHUNK),
    "message_interval": _on_events(R.message_interval),
    "request_index": _on_events(R.request_index),
    "running_byte_totals": _on_events(R.running_byte_totals),
    "running_error_count": _on_events(R.running_error_count),
    "running_interval_avg": _on_events(R.running_interval_avg),
    "carry_forward_last": _on_events(R.carry_forward_last),
    "connection_duration": _on_events(R.connection_duration),
    "lifecycle_flags": _on_events(R.lifecycle_flags),
    "session_summaries": _on_events(R.session_summaries),
    "running_state_continued": running_state_continued,
    "snapshots_continued": snapshots_continued,
    "session_epochs": removal_epochs,
    "running_state_with_removals": removal_state,
    "snapshots_with_removals": removal_snapshots,
    "lookup_session_snapshots": lookup_session_snapshots,
    "lookup_latest_messages": lookup_latest_messages,
    "lookup_inference": lookup_inference,
    "remove_sessions": remove_sessions,
    "attach_results": attach_results,
    "feature_items": feature_items,
    "items_from_events": items_from_events,
    "sequence_items": sequence_items(),
    "sequence_items_in_chunks": sequence_items(_SMALL_CHUNK),
    "admit_items": admit_items(),
    "admit_items_in_chunks": admit_items(2),
    "sequence_admitted_items": sequence_admitted_items,
    "fifo_items": fifo_items,
    "message_payloads": message_payloads,
    "session_payloads": session_payloads,
    "parse_payloads": parse_payloads,
    "validate_payloads": validate_payloads,
    "split_payloads_accepted": split_payloads_accepted,
    "split_payloads_rejected": split_payloads_rejected,
    "snapshot_errors": snapshot_errors,
    "message_vector": message_vector,
    "session_vector": session_vector,
    "vector_long": vector_long,
    "score_constant": _scores(C.score_constant),
    "score_with": _scores(lambda vectors: C.score_with(vectors, C.ThresholdModel())),
    "score_where": _scores(_score_by_rule),
    "inference_responses": inference_responses,
    "validate_responses": validate_responses,
    "invalid_responses": invalid_responses,
    "stream_feature_items": stream_feature_items,
    "stream_session_removal": stream_session_removal,
    "stream_clear": stream_clear,
    "stream_out_of_order": stream_out_of_order,
    "stream_idle_sessions": stream_idle_sessions,
    "stream_numbered_items": stream_numbered_items,
    "stream_score": stream_score,
    "stream_inference_state": stream_inference_state,
}
