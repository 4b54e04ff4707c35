"""DuckDB SQL for the registered queries, written from the state rules, not from the Spark code."""

from __future__ import annotations

EV = """
raw_k AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ev AS (
  SELECT event_id AS event_seq,
         CASE WHEN event_type = 'click' THEN 'RecvCompleted'
              WHEN event_type = 'view' THEN 'SendCompleted'
              WHEN event_type = 'purchase' THEN 'PacketParsed'
              WHEN event_type = 'error' THEN 'ProtocolError'
              WHEN event_type = 'signup' AND k < 50 THEN 'SessionStarted'
              ELSE 'SessionClosed' END AS type,
         user_id AS session_id,
         user_id + 1000 AS socket_handle,
         CAST(k % 4 AS INTEGER) AS logic_worker_id,
         ts AS wall_time,
         epoch_us(ts) AS mono_us,
         CAST(floor(value) AS BIGINT) AS bytes_transferred,
         CAST(CASE WHEN event_type = 'purchase' OR (event_type = 'error' AND k % 3 <> 0)
              THEN k ELSE -1 END AS INTEGER) AS packet_id,
         CAST(CASE WHEN event_type = 'purchase' OR (event_type = 'error' AND k % 2 = 1)
              THEN k + 4 ELSE 0 END AS INTEGER) AS packet_size,
         CAST(CASE WHEN event_type = 'purchase' OR (event_type = 'error' AND k % 2 = 1)
              THEN k ELSE 0 END AS INTEGER) AS payload_size,
         CAST(CASE WHEN event_type = 'error' THEN k ELSE 0 END AS BIGINT) AS error_code,
         CASE WHEN event_type = 'error' THEN 'err-' || k ELSE '' END AS error_message
  FROM raw_k)"""


def state(
    source: str = "ev",
    name: str = "st",
    keys: str = "session_id",
    order: str = "mono_us, event_seq",
) -> str:
    """CTEs giving the session state after every row of ``source``, applied in ``order``."""
    return f"""
{name}_prev AS (
  SELECT *, last_value(CASE WHEN type = 'PacketParsed' THEN mono_us END IGNORE NULLS) OVER (
           PARTITION BY {keys} ORDER BY {order}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_message_us
  FROM {source}),
{name}_raw AS (
  SELECT *,
    first_value(mono_us) OVER c AS first_us,
    first_value(wall_time) OVER c AS first_wall,
    last_value(CASE WHEN type = 'SessionStarted' THEN mono_us END IGNORE NULLS) OVER c AS start_us,
    last_value(CASE WHEN type = 'SessionStarted' THEN wall_time END IGNORE NULLS) OVER c AS start_wall,
    last_value(CASE WHEN type = 'SessionClosed' THEN true WHEN type = 'SessionStarted' THEN false END
               IGNORE NULLS) OVER c AS closed,
    last_value(CASE WHEN type = 'SessionClosed' THEN wall_time END IGNORE NULLS) OVER c AS close_wall,
    CAST(count(CASE WHEN type = 'RecvCompleted' THEN 1 END) OVER c AS BIGINT) AS recv_event_count,
    CAST(count(CASE WHEN type = 'SendCompleted' THEN 1 END) OVER c AS BIGINT) AS send_event_count,
    CAST(coalesce(sum(CASE WHEN type = 'RecvCompleted' THEN bytes_transferred END) OVER c, 0) AS BIGINT)
      AS bytes_received_total,
    CAST(coalesce(sum(CASE WHEN type = 'SendCompleted' THEN bytes_transferred END) OVER c, 0) AS BIGINT)
      AS bytes_sent_total,
    CAST(count(CASE WHEN type = 'PacketParsed' THEN 1 END) OVER c AS BIGINT) AS request_count,
    CAST(count(CASE WHEN type = 'ProtocolError' THEN 1 END) OVER c AS BIGINT) AS error_count,
    first_value(CASE WHEN type = 'PacketParsed' THEN mono_us END IGNORE NULLS) OVER c AS first_message_us,
    last_value(CASE WHEN type = 'PacketParsed' THEN mono_us END IGNORE NULLS) OVER c AS last_message_us,
    last_value(CASE WHEN type = 'PacketParsed'
      THEN coalesce((mono_us - prev_message_us) / CAST(1000.0 AS DOUBLE), 0.0) END IGNORE NULLS) OVER c AS gap_ms,
    last_value(CASE WHEN type = 'PacketParsed' OR (type = 'ProtocolError' AND packet_id >= 0)
      THEN packet_id END IGNORE NULLS) OVER c AS pid,
    last_value(CASE WHEN type = 'PacketParsed' OR (type = 'ProtocolError' AND packet_size > 0)
      THEN packet_size END IGNORE NULLS) OVER c AS psize,
    last_value(CASE WHEN type = 'PacketParsed' OR (type = 'ProtocolError' AND payload_size > 0)
      THEN payload_size END IGNORE NULLS) OVER c AS plsize,
    last_value(CASE WHEN type = 'ProtocolError' THEN error_code END IGNORE NULLS) OVER c AS ecode,
    last_value(CASE WHEN type = 'ProtocolError' THEN error_message END IGNORE NULLS) OVER c AS etext
  FROM {name}_prev
  WINDOW c AS (PARTITION BY {keys} ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT mono_us, event_seq, type, {keys}, socket_handle, logic_worker_id, wall_time,
    packet_id, packet_size, payload_size,
    start_us IS NOT NULL AS is_started,
    coalesce(closed, false) AS is_closed,
    CASE WHEN session_id = 0 THEN wall_time ELSE coalesce(start_wall, first_wall) END
      AS connection_start_wall_time,
    wall_time AS last_event_wall_time,
    close_wall AS connection_close_wall_time,
    CASE WHEN session_id = 0 THEN CAST(0.0 AS DOUBLE)
         ELSE (mono_us - coalesce(start_us, first_us)) / CAST(1000.0 AS DOUBLE) END
      AS connection_duration_ms,
    bytes_received_total, bytes_sent_total, recv_event_count, send_event_count,
    request_count, error_count,
    coalesce(gap_ms, CAST(0.0 AS DOUBLE)) AS last_message_interval_ms,
    CASE WHEN request_count > 1
         THEN (last_message_us - first_message_us) / CAST(1000.0 AS DOUBLE) / (request_count - 1)
         ELSE CAST(0.0 AS DOUBLE) END AS avg_message_interval_ms,
    coalesce(pid, -1) AS last_packet_id,
    coalesce(psize, 0) AS last_packet_size,
    coalesce(plsize, 0) AS last_payload_size,
    coalesce(ecode, 0) AS last_error_code,
    coalesce(etext, '') AS last_error_message
  FROM {name}_raw)"""


STATE_COLUMNS = """session_id, socket_handle, logic_worker_id, is_started, is_closed,
  connection_start_wall_time, last_event_wall_time, connection_close_wall_time,
  connection_duration_ms, bytes_received_total, bytes_sent_total, recv_event_count,
  send_event_count, request_count, error_count, last_message_interval_ms,
  avg_message_interval_ms, last_packet_id, last_packet_size, last_payload_size,
  last_error_code, last_error_message"""

MESSAGES = """
msg AS (
  SELECT mono_us, event_seq, session_id, socket_handle, logic_worker_id,
    wall_time AS message_wall_time, request_count AS request_index, packet_id, packet_size,
    payload_size, connection_duration_ms, last_message_interval_ms AS message_interval_ms,
    bytes_received_total, bytes_sent_total, error_count AS error_count_total
  FROM st WHERE type = 'PacketParsed')"""

LAST = """
fin AS (
  SELECT * FROM st
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY mono_us DESC, event_seq DESC) = 1)"""

RESULTS = """
results AS (
  SELECT session_id, event_seq AS arrival_seq, message_wall_time AS received_wall_time,
    CASE WHEN error_count_total >= 3 THEN 'attack' ELSE 'normal' END AS label,
    error_count_total >= 3 AS is_attack,
    CASE WHEN error_count_total >= 3 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS confidence,
    'threshold-v1' AS model_version, 'message' AS received_event_type
  FROM msg)"""

SEQ = """
items AS (
  SELECT *, row_number() OVER (ORDER BY mono_us, event_seq) AS queue_sequence_id,
    CASE WHEN type = 'PacketParsed' THEN 'MessageSnapshot' ELSE 'SessionSummary' END AS item_type
  FROM st WHERE type IN ('PacketParsed', 'SessionClosed'))"""

HOUR = "(mono_us - mono_us % 3600000000)"

CONTROLS = """
ctl_ev AS (
  SELECT ev.* FROM ev WHERE NOT (type = 'ProtocolError' AND error_code = 99)),
marks AS (
  SELECT session_id, mono_us, event_seq FROM ev WHERE type = 'ProtocolError' AND error_code = 99),
tagged AS (
  SELECT *, 0 AS mark FROM ctl_ev
  UNION ALL BY NAME SELECT *, 1 AS mark FROM marks),
counted AS (
  SELECT *, CAST(sum(mark) OVER (PARTITION BY session_id ORDER BY mono_us, event_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS removals,
    CAST(CASE WHEN mono_us > epoch_us(TIMESTAMP '2024-01-15 00:00:00') THEN 1 ELSE 0 END AS BIGINT)
      AS clears
  FROM tagged),
epochs AS (SELECT * FROM counted WHERE mark = 0)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _state_of(columns: str) -> str:
    return f"{_with(EV, state())} SELECT mono_us, event_seq, type, session_id, {columns} FROM st"


def _final_of(columns: str) -> str:
    return f"{_with(EV, state(), LAST)} SELECT session_id, {columns} FROM fin"


MESSAGE_VECTOR = """CAST(packet_size AS DOUBLE) AS v0, CAST(payload_size AS DOUBLE) AS v1,
  connection_duration_ms AS v2, message_interval_ms AS v3,
  CAST(bytes_received_total AS DOUBLE) AS v4, CAST(bytes_sent_total AS DOUBLE) AS v5,
  CAST(error_count_total AS DOUBLE) AS v6"""
MESSAGE_NAMES = (
    "packet_size,payload_size,connection_duration_ms,message_interval_ms,"
    "bytes_received_total,bytes_sent_total,error_count_total"
)
SESSION_VECTOR = """connection_duration_ms AS v0, CAST(bytes_received_total AS DOUBLE) AS v1,
  CAST(bytes_sent_total AS DOUBLE) AS v2, CAST(recv_event_count AS DOUBLE) AS v3,
  CAST(send_event_count AS DOUBLE) AS v4, CAST(request_count AS DOUBLE) AS v5,
  CAST(error_count AS DOUBLE) AS v6, avg_message_interval_ms AS v7"""
SESSION_NAMES = (
    "connection_duration_ms,bytes_received_total,bytes_sent_total,recv_event_count,"
    "send_event_count,request_count,error_count,avg_message_interval_ms"
)
NUMBERED_MESSAGES = f"""
mseq AS (
  SELECT items.queue_sequence_id, msg.* FROM msg JOIN items USING (event_seq))"""

# how the payload fixture breaks payloads, by queue_sequence_id % 10
BROKEN = """
broken AS (
  SELECT queue_sequence_id, item_type, queue_sequence_id % 10 AS fault FROM items),
codes AS (
  SELECT queue_sequence_id, item_type,
    CASE WHEN fault = 0 THEN 'payload:parse_error'
         WHEN fault = 1 THEN 'event_type:unknown'
         WHEN fault = 2 THEN 'schema_version:unsupported'
         WHEN fault = 3 AND item_type = 'MessageSnapshot' THEN 'message.packet_id:missing'
         WHEN fault = 4 THEN 'session.session_id:below_zero'
         WHEN fault = 5 THEN 'session.socket_handle:type'
         ELSE '' END AS errors
  FROM broken)"""

_MESSAGE_OF_STATE = {
    "message_wall_time": "wall_time",
    "request_index": "request_count",
    "message_interval_ms": "last_message_interval_ms",
    "error_count_total": "error_count",
}
_MESSAGE_FIELDS = (
    *("session_id", "socket_handle", "logic_worker_id", "message_wall_time", "request_index"),
    *("packet_id", "packet_size", "payload_size", "connection_duration_ms", "message_interval_ms"),
    *("bytes_received_total", "bytes_sent_total", "error_count_total"),
)
FLAT_ITEM = ",\n".join(
    [
        f"CASE WHEN type = 'PacketParsed' THEN {_MESSAGE_OF_STATE.get(f, f)} END AS m_{f}"
        for f in _MESSAGE_FIELDS
    ]
    + [
        f"CASE WHEN type <> 'PacketParsed' THEN {f.strip()} END AS s_{f.strip()}"
        for f in STATE_COLUMNS.split(",")
    ]
    + ["CASE WHEN type = 'PacketParsed' THEN 'MessageSnapshot' ELSE 'SessionSummary' END AS type"]
)

_STATE_RESULT = """
  SELECT session_id,
    max_by(arrival_seq, arrival_seq) AS latest_arrival_seq,
    max_by(label, arrival_seq) AS latest_label,
    max_by(is_attack, arrival_seq) AS latest_is_attack,
    max_by(confidence, arrival_seq) AS latest_confidence,
    min_by(received_wall_time, arrival_seq) AS first_result_wall_time,
    max_by(received_wall_time, arrival_seq) AS last_result_wall_time,
    count(*) AS total_result_count,
    CAST(count(*) FILTER (WHERE is_attack) AS BIGINT) AS attack_result_count
  FROM results GROUP BY session_id"""

_MSG = _with(EV, state(), MESSAGES)
_SEQ = _with(EV, state(), SEQ)
_RES = _with(EV, state(), MESSAGES, RESULTS)
_EPOCH_STATE = _with(
    EV, CONTROLS, state("epochs", "est", "session_id, removals, clears")
)

ORACLES: dict[str, str] = {
    "normalize_events": f"""{_with(EV)}
      SELECT event_seq,
        CASE WHEN event_seq % 7 = 0 THEN 'ProtocolError' ELSE type END AS type, session_id,
        CASE WHEN event_seq % 5 = 0 THEN -1 ELSE logic_worker_id END AS logic_worker_id,
        CASE WHEN event_seq % 5 = 0 THEN 0 ELSE bytes_transferred END AS bytes_transferred,
        CASE WHEN event_seq % 3 = 0 THEN -1 ELSE packet_id END AS packet_id,
        CASE WHEN event_seq % 3 = 0 THEN '' ELSE error_message END AS error_message
      FROM ev""",
    "route_events": f"""{_with(EV)}, odd AS (
        SELECT event_seq, CASE WHEN event_seq % 11 = 0 THEN 'Heartbeat' ELSE type END AS type FROM ev)
      SELECT event_seq, type, type <> 'Heartbeat' AS counts, type = 'PacketParsed' AS emits_message,
        type = 'SessionClosed' AS emits_summary, type = 'Heartbeat' AS ignored FROM odd""",
    "message_events": f"{_with(EV)} SELECT event_seq, session_id, packet_id FROM ev WHERE type = 'PacketParsed'",
    "close_events": f"{_with(EV)} SELECT event_seq, session_id, wall_time FROM ev WHERE type = 'SessionClosed'",
    "packet_outcome": """WITH p AS (
        SELECT event_id AS packet_seq, user_id AS session_id,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
      c AS (
        SELECT packet_seq, session_id, CASE WHEN k % 5 NOT IN (1, 2) THEN 'unknown_id'
          WHEN k % 3 = 0 THEN 'malformed' WHEN k % 4 <> 0 THEN 'trailing_bytes' ELSE 'ok' END AS outcome
        FROM p)
      SELECT *, outcome IN ('malformed', 'trailing_bytes') AS closes_connection FROM c""",
    "duration_ms": f"""{_with(EV)} SELECT event_seq,
      (mono_us - 1704067200000000) / CAST(1000.0 AS DOUBLE) AS ms FROM ev""",
    "epoch_times": """SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis,
      epoch_us(ts) AS micros FROM events""",
    "elapsed_whole_ms": f"""{_with(EV)} SELECT event_seq,
      CAST(trunc((mono_us - 1704067200000000) / CAST(1000.0 AS DOUBLE)) AS BIGINT) AS ms,
      CAST(trunc((1704067200000000 - mono_us) / CAST(1000.0 AS DOUBLE)) AS BIGINT) AS back_ms FROM ev""",
    "session_snapshots": f"{_with(EV, state(), LAST)} SELECT {STATE_COLUMNS} FROM fin",
    "recv_totals": _final_of("recv_event_count, bytes_received_total"),
    "send_totals": _final_of("send_event_count, bytes_sent_total"),
    "request_totals": _final_of("request_count, last_packet_id, last_packet_size, last_payload_size"),
    "error_totals": _final_of("error_count, last_error_code, last_error_message"),
    "message_interval_avg": _final_of("avg_message_interval_ms"),
    "session_lifecycle": _final_of(
        "is_started, is_closed, connection_start_wall_time, last_event_wall_time, "
        "connection_close_wall_time, connection_duration_ms, socket_handle, logic_worker_id"
    ),
    "latest_messages": f"""{_MSG} SELECT * FROM msg
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY request_index DESC) = 1""",
    "inference_session_state": f"{_RES} {_STATE_RESULT}",
    "inference_session_count": f"{_RES} SELECT count(DISTINCT session_id) AS session_count FROM results",
    "admission_stats": f"""{_with(EV)} SELECT {HOUR} AS bucket, count(*) AS offered,
      CAST(least(count(*), 3) AS BIGINT) AS admitted,
      CAST(count(*) - least(count(*), 3) AS BIGINT) AS dropped
      FROM ev WHERE type IN ('PacketParsed', 'SessionClosed') GROUP BY 1""",
    "running_session_state": f"{_with(EV, state())} SELECT mono_us, event_seq, type, {STATE_COLUMNS} FROM st",
    "message_snapshots": f"{_MSG} SELECT * FROM msg",
    "message_interval": f"{_MSG} SELECT mono_us, event_seq, session_id, message_interval_ms FROM msg",
    "request_index": f"{_MSG} SELECT mono_us, event_seq, session_id, request_index FROM msg",
    "running_byte_totals": _state_of(
        "bytes_received_total, bytes_sent_total, recv_event_count, send_event_count"
    ),
    "running_error_count": _state_of("error_count"),
    "running_interval_avg": _state_of("avg_message_interval_ms"),
    "carry_forward_last": _state_of(
        "last_packet_id, last_packet_size, last_payload_size, last_error_code, last_error_message"
    ),
    "connection_duration": _state_of("connection_duration_ms"),
    "lifecycle_flags": _state_of("is_started, is_closed, connection_close_wall_time"),
    "session_summaries": f"""{_with(EV, state())} SELECT mono_us, event_seq, {STATE_COLUMNS}
      FROM st WHERE type = 'SessionClosed'""",
    "session_epochs": f"{_with(EV, CONTROLS)} SELECT event_seq, session_id, removals, clears FROM epochs",
    "running_state_with_removals": f"""{_EPOCH_STATE}
      SELECT mono_us, event_seq, type, removals, clears, {STATE_COLUMNS} FROM est""",
    "snapshots_with_removals": f"""{_EPOCH_STATE},
      ends AS (SELECT session_id, max(removals) AS removals FROM counted GROUP BY session_id)
      SELECT {STATE_COLUMNS} FROM est JOIN ends USING (session_id, removals) WHERE clears = 1
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY mono_us DESC, event_seq DESC) = 1""",
    "lookup_session_snapshots": f"""{_with(EV, state(), LAST)} SELECT {STATE_COLUMNS} FROM fin
      WHERE session_id % 10 = 3""",
    "lookup_latest_messages": f"""{_MSG} SELECT * FROM msg WHERE session_id % 10 = 3
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY request_index DESC) = 1""",
    "lookup_inference": f"{_RES} SELECT * FROM ({_STATE_RESULT}) WHERE session_id % 10 = 3",
    "remove_sessions": f"""{_with(EV, state(), LAST)} SELECT {STATE_COLUMNS} FROM fin
      WHERE session_id % 10 <> 3""",
    "attach_results": f"""{_SEQ} SELECT CAST(queue_sequence_id AS VARCHAR) AS request_id,
      queue_sequence_id, session_id, 'normal' AS label,
      CASE WHEN item_type = 'MessageSnapshot' THEN 'message' ELSE 'session_summary' END
        AS received_event_type FROM items""",
    "feature_items": f"""{_with(EV, state())} SELECT mono_us, event_seq, {FLAT_ITEM} FROM st
      WHERE type IN ('PacketParsed', 'SessionClosed')""",
    "sequence_items": f"{_SEQ} SELECT event_seq, item_type AS type, queue_sequence_id FROM items",
    "admit_items": f"""{_with(EV)}, b AS (
        SELECT event_seq, {HOUR} AS bucket, row_number() OVER (
          PARTITION BY {HOUR} ORDER BY mono_us, event_seq) AS bucket_position
        FROM ev WHERE type IN ('PacketParsed', 'SessionClosed'))
      SELECT *, bucket_position <= 3 AS admitted FROM b""",
    "sequence_admitted_items": f"""{_with(EV)}, b AS (
        SELECT event_seq, mono_us, row_number() OVER (
          PARTITION BY {HOUR} ORDER BY mono_us, event_seq) AS bucket_position
        FROM ev WHERE type IN ('PacketParsed', 'SessionClosed'))
      SELECT event_seq, row_number() OVER (ORDER BY mono_us, event_seq) AS queue_sequence_id
      FROM b WHERE bucket_position <= 3""",
    "fifo_items": f"""{_SEQ} SELECT queue_sequence_id, event_seq, item_type AS type FROM items
      ORDER BY queue_sequence_id""",
    "message_payloads": f"""{_with(EV, state(), MESSAGES, SEQ, NUMBERED_MESSAGES)}
      SELECT queue_sequence_id, 'v1' AS schema_version, 'message' AS event_type,
        strftime(message_wall_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "timestamp", session_id,
        socket_handle, logic_worker_id, request_index, packet_id, {MESSAGE_VECTOR} FROM mseq""",
    "session_payloads": f"""{_SEQ}
      SELECT queue_sequence_id, 'v1' AS schema_version, 'session_summary' AS event_type,
        strftime(wall_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "timestamp", session_id,
        is_started, is_closed, last_error_code, last_error_message, {SESSION_VECTOR}
      FROM items WHERE item_type = 'SessionSummary'""",
    "parse_payloads": f"""{_with(EV, state(), SEQ, BROKEN)} SELECT queue_sequence_id,
        fault > 0 AS is_json,
        CASE WHEN fault = 0 THEN NULL
             WHEN fault = 1 THEN 'x' || CASE WHEN item_type = 'MessageSnapshot' THEN 'message' ELSE 'session_summary' END
             WHEN item_type = 'MessageSnapshot' THEN 'message' ELSE 'session_summary' END AS event_type,
        fault > 1 AND item_type = 'MessageSnapshot' AS is_message_request,
        fault > 1 AND item_type = 'SessionSummary' AS is_session_request
      FROM broken""",
    "validate_payloads": f"""{_with(EV, state(), SEQ, BROKEN)}
      SELECT queue_sequence_id, errors FROM codes""",
    "split_payloads_accepted": f"""{_with(EV, state(), SEQ, BROKEN)}
      SELECT queue_sequence_id FROM codes WHERE errors = ''""",
    "split_payloads_rejected": f"""{_with(EV, state(), SEQ, BROKEN)}
      SELECT queue_sequence_id, errors FROM codes WHERE errors <> ''""",
    "snapshot_errors": f"""{_MSG} SELECT event_seq,
      CASE WHEN connection_duration_ms - 1000 < 0 THEN 'connection_duration_ms:below_zero' ELSE '' END AS errors
      FROM msg""",
    "message_vector": f"""{_MSG} SELECT event_seq, 'message' AS event_type,
      '{MESSAGE_NAMES}' AS names, {MESSAGE_VECTOR} FROM msg""",
    "session_vector": f"""{_with(EV, state())} SELECT event_seq, 'session_summary' AS event_type,
      '{SESSION_NAMES}' AS names, {SESSION_VECTOR} FROM st WHERE type = 'SessionClosed'""",
    "vector_long": f"""{_MSG}, wide AS (SELECT event_seq,
        string_split('{MESSAGE_NAMES}', ',') AS n, [v0, v1, v2, v3, v4, v5, v6] AS v
        FROM (SELECT event_seq, {MESSAGE_VECTOR} FROM msg))
      SELECT event_seq, CAST(i - 1 AS INTEGER) AS position, n[i] AS name, v[i] AS value
      FROM wide, (SELECT unnest(range(1, 8)) AS i)""",
    "score_constant": f"""{_MSG} SELECT event_seq, 'normal' AS label, false AS is_attack,
      CAST(0.5 AS DOUBLE) AS confidence, 'dummy-v0' AS model_version FROM msg""",
    "score_with": f"""{_RES} SELECT arrival_seq AS event_seq, label, is_attack, confidence, model_version
      FROM results""",
    "score_where": f"""{_RES} SELECT arrival_seq AS event_seq, label, is_attack, confidence, model_version
      FROM results""",
    "inference_responses": f"""{_SEQ} SELECT CAST(queue_sequence_id AS VARCHAR) AS request_id,
      'normal' AS label, false AS is_attack, CAST(0.5 AS DOUBLE) AS confidence,
      'dummy-v0' AS model_version,
      CASE WHEN item_type = 'MessageSnapshot' THEN 'message' ELSE 'session_summary' END
        AS received_event_type FROM items""",
    "validate_responses": f"""{_SEQ} SELECT CAST(queue_sequence_id AS VARCHAR) AS request_id,
      queue_sequence_id / CAST(1000.0 AS DOUBLE) AS confidence FROM items
      WHERE queue_sequence_id <= 1000""",
    "invalid_responses": f"""{_SEQ} SELECT CAST(queue_sequence_id AS VARCHAR) AS request_id,
      queue_sequence_id / CAST(1000.0 AS DOUBLE) AS confidence FROM items
      WHERE queue_sequence_id > 1000""",
    "flagship": f"""{_MSG} SELECT session_id, count(*) AS total_result_count,
      CAST(0 AS BIGINT) AS attack_result_count, min(message_wall_time) AS first_result_wall_time,
      max(message_wall_time) AS last_result_wall_time, CAST(0.5 AS DOUBLE) AS latest_confidence
      FROM msg GROUP BY session_id""",
}
for _split in ("running_session_state", "message_snapshots", "sequence_items", "admit_items"):
    ORACLES[f"{_split}_in_chunks"] = ORACLES[_split]
ORACLES["items_from_events"] = ORACLES["feature_items"]
ORACLES["running_state_continued"] = ORACLES["running_session_state"]
ORACLES["snapshots_continued"] = ORACLES["session_snapshots"]
ORACLES["stream_feature_items"] = ORACLES["feature_items"]
ORACLES["stream_inference_state"] = ORACLES["inference_session_state"]
ORACLES["stream_score"] = f"""{_SEQ} SELECT session_id, event_seq AS arrival_seq,
  wall_time AS received_wall_time, CAST(event_seq AS VARCHAR) AS request_id, 'normal' AS label,
  false AS is_attack, CAST(0.5 AS DOUBLE) AS confidence, 'dummy-v0' AS model_version,
  CASE WHEN item_type = 'MessageSnapshot' THEN 'message' ELSE 'session_summary' END
    AS received_event_type FROM items"""
_LATE = """late AS (
  SELECT *, CASE WHEN mono_us > epoch_us(TIMESTAMP '2024-01-15 00:00:00') THEN 0 ELSE 1 END AS arrival
  FROM ev)"""
ORACLES["stream_out_of_order"] = f"""{_with(EV, _LATE, state("late", order="arrival, mono_us, event_seq"))}
SELECT mono_us, event_seq, {FLAT_ITEM} FROM st WHERE type IN ('PacketParsed', 'SessionClosed')"""
ORACLES["stream_idle_sessions"] = f"""{_with(EV, _LATE, state("late", keys="session_id, arrival"))}
SELECT mono_us, event_seq, {FLAT_ITEM} FROM st WHERE type IN ('PacketParsed', 'SessionClosed')"""
ORACLES["stream_numbered_items"] = ORACLES["sequence_items"]
ORACLES["stream_clear"] = f"""{_with(EV, CONTROLS, state("epochs", "st", "session_id, removals, clears"))}
SELECT mono_us, event_seq, {FLAT_ITEM} FROM st WHERE type IN ('PacketParsed', 'SessionClosed')"""
ORACLES["stream_session_removal"] = f"""{_with(EV, CONTROLS.split('counted AS (')[0].rstrip().rstrip(','))},
counted AS (
  SELECT *, CAST(sum(mark) OVER (PARTITION BY session_id ORDER BY mono_us, event_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS removals FROM tagged),
epochs AS (SELECT * FROM counted WHERE mark = 0),
{state("epochs", "st", "session_id, removals")}
SELECT mono_us, event_seq, {FLAT_ITEM} FROM st WHERE type IN ('PacketParsed', 'SessionClosed')"""
