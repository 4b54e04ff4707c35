"""Queries of the sources and sinks: each writes to a run folder, reads back and compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oracle import queries as Q, sql
from sessora import schemas as S
from sessora.operators import lookups as L
from sessora.operators import payloads as J
from sessora.operators import running as R
from sessora.operators import snapshots as N
from sessora.operators import vectors as V
from sessora.operators.events import normalize_events
from sessora.sources import events as SE
from sessora.sources import payloads as SP
from sessora.sources import results as SR
from sessora.sources.adapter import adapt_events
from sessora.streaming import ingest as XG
from sessora.streaming import scoring as XS

#: Session ids of the short lists; one of them is nobody's, one is no id.
SHORT_LIST = [3, 13, -1, None]
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_events(Q.raw_events(spark, sf_dir))


def scan_network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log scanned from Parquet and, its other half, from JSON."""
    folder, log = Q.run_folder(spark), _log(spark, sf_dir)
    log.where("event_seq % 2 = 0").write.parquet(f"{folder}/parquet")
    log.where("event_seq % 2 = 1").write.options(**_MICROS).json(f"{folder}/json")
    scanned = SE.scan_network_events(spark, f"{folder}/parquet")
    return scanned.unionByName(SE.scan_network_events(spark, f"{folder}/json", "json"))


def _broken_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as JSON lines, four in ten of them no events."""
    folder, log = Q.run_folder(spark), _log(spark, sf_dir)
    fault = F.col("event_seq") % 10
    large = F.lit("18446744073709551615").cast("decimal(20,0)")
    odd = log.withColumns(
        {
            "session_id": F.when(fault == 1, large).otherwise(F.col("session_id")),
            "socket_handle": F.when(fault == 2, large).otherwise(F.col("socket_handle")),
            "mono_us": F.when(fault != 3, F.col("mono_us")),
        }
    )
    line = F.to_json(F.struct(*S.NETWORK_EVENTS.fieldNames()), _MICROS)
    text = F.when(fault == 0, F.concat(F.lit("not json "), "event_seq")).otherwise(line)
    odd.select(text.alias("value")).write.text(f"{folder}/log")
    return f"{folder}/log"


def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = SE.scan_rejects(spark, _broken_log(spark, sf_dir), "json")
    record = F.when(F.col("reason") == "corrupt", F.col("record"))
    return rejects.select("event_seq", "reason", record.alias("record"))


def scan_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.scan_network_events(spark, _broken_log(spark, sf_dir), "json")


def stream_network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of several files, one a micro-batch."""
    folder = Q.run_folder(spark)
    _log(spark, sf_dir).repartition(3, "event_seq").write.parquet(f"{folder}/in")
    stream = SE.stream_network_events(spark, f"{folder}/in", max_files_per_trigger=1)
    XS.write_stream(stream, f"{folder}/out", f"{folder}/cp", available_now=True).awaitTermination()
    return normalize_events(spark.read.schema(S.NETWORK_EVENTS).parquet(f"{folder}/out"))


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """The broken log as a stream, split into the tables of events and of rejects."""
    folder = _broken_log(spark, sf_dir)
    rows = SE.stream_event_rows(spark, folder, "json", max_files_per_trigger=1)
    XG.stream_split_events(rows, f"{folder}_out", f"{folder}_cp", run="one", available_now=True).awaitTermination()
    return f"{folder}_out"


def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XG.read_events(spark, _ingested(spark, sf_dir))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.when(F.col("reason") == "corrupt", F.col("record"))
    rejects = XG.read_rejects(spark, _ingested(spark, sf_dir))
    return rejects.select("event_seq", "reason", record.alias("record"))


def write_payload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted payloads, logged and scanned again."""
    folder = Q.run_folder(spark)
    SP.write_payload_log(J.split_payloads(Q._validated(spark, sf_dir))[0], f"{folder}/log")
    again = J.parse_payloads(SP.scan_payloads(spark, f"{folder}/log"))
    number = F.coalesce("message_request.queue_sequence_id", "session_request.queue_sequence_id")
    return again.select(number.alias("queue_sequence_id"))


def scan_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies as text, broken ones too, checked after the scan."""
    folder = Q.run_folder(spark)
    Q.broken_payloads(spark, sf_dir).select("value").write.text(f"{folder}/in")
    checked = J.validate_payloads(J.parse_payloads(SP.scan_payloads(spark, f"{folder}/in")))
    errors = F.array_join("errors", ",").alias("errors")
    return checked.select(errors).groupBy("errors").agg(F.count("*").alias("n"))


def write_vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Q.run_folder(spark)
    SP.write_vector_log(V.message_vector(R.message_snapshots(Q.events(spark, sf_dir))), f"{folder}/log")
    shape = "names array<string>, values array<double>"
    read = SP.scan_payloads(spark, f"{folder}/log").select(F.from_json("value", shape).alias("v"))
    values = [F.get("v.values", F.lit(i)).alias(f"v{i}") for i in range(len(S.MESSAGE_FEATURES))]
    return read.select(F.array_join("v.names", ",").alias("names"), *values)


def write_inference_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that both start at batch 0, one of whose batches is written twice."""
    folder = f"{Q.run_folder(spark)}/results"
    results = Q.threshold_results(spark, sf_dir)
    odd = results.where("arrival_seq % 2 = 1")
    SR.write_inference_results(results.where("arrival_seq % 2 = 0"), folder, "first")
    SR.result_writer(folder, "second")(odd, 0)
    SR.result_writer(folder, "second")(odd, 0)
    columns = ["session_id", "arrival_seq", "received_wall_time", "label", "is_attack", "confidence"]
    return SR.read_inference_results(spark, folder).select(*columns)


def lookup_short_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lookup_session_snapshots(N.session_snapshots(Q.events(spark, sf_dir)), SHORT_LIST)


def remove_short_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.remove_sessions(N.session_snapshots(Q.events(spark, sf_dir)), SHORT_LIST)


QUERIES: dict[str, Q.Query] = {
    "scan_network_events": scan_network_events,
    "scan_rejects": scan_rejects,
    "scan_accepted": scan_accepted,
    "stream_network_events": stream_network_events,
    "stream_accepted": stream_accepted,
    "stream_rejects": stream_rejects,
    "scan_payloads": scan_payloads,
    "write_payload_log": write_payload_log,
    "write_vector_log": write_vector_log,
    "write_inference_results": write_inference_results,
    "lookup_short_list": lookup_short_list,
    "remove_short_list": remove_short_list,
}

_EV = sql._with(sql.EV)
_FIN = f"{sql._with(sql.EV, sql.state(), sql.LAST)} SELECT {sql.STATE_COLUMNS} FROM fin"

ORACLES: dict[str, str] = {
    "scan_network_events": f"{_EV} SELECT * FROM ev",
    "stream_network_events": f"{_EV} SELECT * FROM ev",
    "scan_rejects": f"""{_EV} SELECT
        CASE WHEN event_seq % 10 <> 0 THEN event_seq END AS event_seq,
        CASE event_seq % 10 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'session_id too large'
             WHEN 2 THEN 'socket_handle too large' ELSE 'no mono_us' END AS reason,
        CASE WHEN event_seq % 10 = 0 THEN 'not json ' || event_seq END AS record
      FROM ev WHERE event_seq % 10 < 4""",
    "scan_accepted": f"{_EV} SELECT * FROM ev WHERE event_seq % 10 >= 4",
    "scan_payloads": f"""{sql._with(sql.EV, sql.state(), sql.SEQ, sql.BROKEN)}
      SELECT errors, count(*) AS n FROM codes GROUP BY errors""",
    "write_payload_log": sql.ORACLES["split_payloads_accepted"],
    "write_vector_log": f"""{sql._with(sql.EV, sql.state(), sql.MESSAGES)}
      SELECT '{sql.MESSAGE_NAMES}' AS names, {sql.MESSAGE_VECTOR} FROM msg""",
    "write_inference_results": f"""{sql._with(sql.EV, sql.state(), sql.MESSAGES, sql.RESULTS)}
      SELECT session_id, arrival_seq, received_wall_time, label, is_attack, confidence FROM results""",
    "lookup_short_list": f"{_FIN} WHERE session_id IN (3, 13, -1)",
    "remove_short_list": f"{_FIN} WHERE session_id NOT IN (3, 13, -1)",
}
ORACLES["stream_accepted"], ORACLES["stream_rejects"] = ORACLES["scan_accepted"], ORACLES["scan_rejects"]
