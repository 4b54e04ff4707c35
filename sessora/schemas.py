"""Table schemas and fixed values of the session data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: event kinds -------------------------------------------
SESSION_STARTED = "SessionStarted"
SESSION_CLOSED = "SessionClosed"
RECV_COMPLETED = "RecvCompleted"
SEND_COMPLETED = "SendCompleted"
PACKET_PARSED = "PacketParsed"
PROTOCOL_ERROR = "ProtocolError"
EVENT_KINDS = (
    SESSION_STARTED,
    SESSION_CLOSED,
    RECV_COMPLETED,
    SEND_COMPLETED,
    PACKET_PARSED,
    PROTOCOL_ERROR,
)

# control rows that drop kept state; they are not network events
REMOVE_SESSION = "RemoveSession"
CLEAR = "Clear"

# --- fixed values: defaults of an event's optional fields ------------------
EVENT_DEFAULTS = {
    "type": PROTOCOL_ERROR,
    "session_id": 0,
    "socket_handle": 0,
    "logic_worker_id": -1,
    "bytes_transferred": 0,
    "packet_id": -1,
    "packet_size": 0,
    "payload_size": 0,
    "error_code": 0,
    "error_message": "",
}

# --- fixed values: item and payload tags -----------------------------------
MESSAGE_ITEM = "MessageSnapshot"
SESSION_ITEM = "SessionSummary"
SCHEMA_VERSION = "v1"
MESSAGE_EVENT = "message"
SESSION_EVENT = "session_summary"

# --- fixed values: vector order --------------------------------------------
MESSAGE_FEATURES = (
    "packet_size",
    "payload_size",
    "connection_duration_ms",
    "message_interval_ms",
    "bytes_received_total",
    "bytes_sent_total",
    "error_count_total",
)
SESSION_FEATURES = (
    "connection_duration_ms",
    "bytes_received_total",
    "bytes_sent_total",
    "recv_event_count",
    "send_event_count",
    "request_count",
    "error_count",
    "avg_message_interval_ms",
)

# --- fixed values: the answer of the constant model -------------------------
CONSTANT_LABEL = "normal"
CONSTANT_IS_ATTACK = False
CONSTANT_CONFIDENCE = 0.5
CONSTANT_MODEL_VERSION = "dummy-v0"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_BOOL, _STR, _TS = T.BooleanType(), T.StringType(), T.TimestampType()

#: ``event_seq`` is arrival order; ``(mono_us, event_seq)`` is the order used everywhere.
NETWORK_EVENTS = _schema(
    ("event_seq", _LONG),
    ("type", _STR),
    ("session_id", _LONG),
    ("socket_handle", _LONG),
    ("logic_worker_id", _INT),
    ("wall_time", _TS),
    ("mono_us", _LONG),
    ("bytes_transferred", _LONG),
    ("packet_id", _INT),
    ("packet_size", _INT),
    ("payload_size", _INT),
    ("error_code", _LONG),
    ("error_message", _STR),
)

ORDER = ("mono_us", "event_seq")

SESSION_STATE = _schema(
    ("session_id", _LONG),
    ("socket_handle", _LONG),
    ("logic_worker_id", _INT),
    ("is_started", _BOOL),
    ("is_closed", _BOOL),
    ("connection_start_wall_time", _TS),
    ("last_event_wall_time", _TS),
    ("connection_close_wall_time", _TS),
    ("connection_duration_ms", _DOUBLE),
    ("bytes_received_total", _LONG),
    ("bytes_sent_total", _LONG),
    ("recv_event_count", _LONG),
    ("send_event_count", _LONG),
    ("request_count", _LONG),
    ("error_count", _LONG),
    ("last_message_interval_ms", _DOUBLE),
    ("avg_message_interval_ms", _DOUBLE),
    ("last_packet_id", _INT),
    ("last_packet_size", _INT),
    ("last_payload_size", _INT),
    ("last_error_code", _LONG),
    ("last_error_message", _STR),
)

MESSAGE_SNAPSHOT = _schema(
    ("session_id", _LONG),
    ("socket_handle", _LONG),
    ("logic_worker_id", _INT),
    ("message_wall_time", _TS),
    ("request_index", _LONG),
    ("packet_id", _INT),
    ("packet_size", _INT),
    ("payload_size", _INT),
    ("connection_duration_ms", _DOUBLE),
    ("message_interval_ms", _DOUBLE),
    ("bytes_received_total", _LONG),
    ("bytes_sent_total", _LONG),
    ("error_count_total", _LONG),
)

INFERENCE_RESPONSE = _schema(
    ("request_id", _STR),
    ("label", _STR),
    ("is_attack", _BOOL),
    ("confidence", _DOUBLE),
    ("model_version", _STR),
    ("received_event_type", _STR),
)

INFERENCE_RESULT = T.StructType(
    _schema(("session_id", _LONG), ("arrival_seq", _LONG), ("received_wall_time", _TS)).fields
    + INFERENCE_RESPONSE.fields
)
