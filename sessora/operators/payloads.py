"""JSON payloads of feature items: writing, reading, checking, splitting.

A payload is a tagged object: ``event_type`` says whether it describes a message or a
session summary. Reading goes through a variant column, parsed once per row, so that the
lenient number rules of the scoring service can be kept: ``"12"``, ``12.0`` and ``true``
are integers, ``12.5`` and ``null`` are not. Text that the variant parser refuses gets a second reading
by the service's own rules: bare ``NaN`` and ``Infinity`` are numbers, and the last of repeated keys counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sessora import schemas as S
from sessora.functions import iso_utc
from sessora.operators.vectors import vector, vector_names

# ---------------------------------------------------------------------------
# fixed values: fields of the two payloads, in order. '>=0' marks a lower bound of zero.
# ---------------------------------------------------------------------------
_ENVELOPE = """
    queue_sequence_id int >=0
    timestamp str
"""
_MESSAGE_FIELDS = """
    session.session_id int >=0
    session.socket_handle int >=0
    session.logic_worker_id int
    session.connection_duration_ms float >=0
    session.bytes_received_total int >=0
    session.bytes_sent_total int >=0
    session.error_count_total int >=0
    message.request_index int >=0
    message.packet_id int
    message.packet_size int >=0
    message.payload_size int >=0
    message.message_interval_ms float >=0
    features.packet_size int >=0
    features.payload_size int >=0
    features.connection_duration_ms float >=0
    features.message_interval_ms float >=0
    features.bytes_received_total int >=0
    features.bytes_sent_total int >=0
    features.error_count_total int >=0
"""
_SESSION_FIELDS = """
    session.session_id int >=0
    session.socket_handle int >=0
    session.logic_worker_id int
    session.is_started bool
    session.is_closed bool
    session.connection_duration_ms float >=0
    session.bytes_received_total int >=0
    session.bytes_sent_total int >=0
    session.recv_event_count int >=0
    session.send_event_count int >=0
    session.request_count int >=0
    session.error_count int >=0
    session.avg_message_interval_ms float >=0
    session.last_error_code int >=0
    session.last_error_message str
    features.connection_duration_ms float >=0
    features.bytes_received_total int >=0
    features.bytes_sent_total int >=0
    features.recv_event_count int >=0
    features.send_event_count int >=0
    features.request_count int >=0
    features.error_count int >=0
    features.avg_message_interval_ms float >=0
"""
# texts read as booleans
_TRUE_TEXTS = ("1", "true", "t", "yes", "y", "on")
_FALSE_TEXTS = ("0", "false", "f", "no", "n", "off")
# texts read as numbers
_INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*(\.0+)?$"
_FLOAT_TEXT = r"^[+-]?([0-9]+(_[0-9]+)*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE_TEXT = r"(?i)^\+?inf(inity)?$"

_SQL_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string"}


@dataclass(frozen=True)
class PayloadField:
    path: str
    kind: str
    non_negative: bool

    @property
    def group(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


def _fields(text: str) -> list[PayloadField]:
    rows = [line.split() for line in text.strip().splitlines()]
    return [PayloadField(row[0], row[1], ">=0" in row) for row in rows]


PAYLOAD_FIELDS = {
    S.MESSAGE_EVENT: _fields(_ENVELOPE) + _fields(_MESSAGE_FIELDS),
    S.SESSION_EVENT: _fields(_ENVELOPE) + _fields(_SESSION_FIELDS),
}
_REQUEST_COLUMN = {S.MESSAGE_EVENT: "message_request", S.SESSION_EVENT: "session_request"}


# ---------------------------------------------------------------------------
# writing
# ---------------------------------------------------------------------------


_ITEMS = {
    S.MESSAGE_ITEM: (S.MESSAGE_EVENT, "message", "message_wall_time"),
    S.SESSION_ITEM: (S.SESSION_EVENT, "session", "last_event_wall_time"),
}


def _body(item: str) -> Column:
    """JSON request of an item of one kind."""
    event, source, time = _ITEMS[item]
    groups: dict[str, list[Column]] = {}
    for field in PAYLOAD_FIELDS[event]:
        if field.group:
            column = F.col(f"{source}.{field.name}").alias(field.name)
            groups.setdefault(field.group, []).append(column)
    body = F.struct(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit(event).alias("event_type"),
        "queue_sequence_id",
        iso_utc(F.col(f"{source}.{time}")).alias("timestamp"),
        *[F.struct(*columns).alias(group) for group, columns in groups.items()],
    )
    return F.to_json(body)


def item_payloads(items: DataFrame) -> DataFrame:
    """``queue_sequence_id`` and the JSON request of items of both kinds, in one pass."""
    kind = F.col("type")
    value = F.when(kind == S.MESSAGE_ITEM, _body(S.MESSAGE_ITEM)).when(
        kind == S.SESSION_ITEM, _body(S.SESSION_ITEM)
    )
    return items.where(kind.isin(*_ITEMS)).select("queue_sequence_id", value.alias("value"))


def message_payloads(items: DataFrame) -> DataFrame:
    """JSON requests of the message items."""
    return item_payloads(items.where(F.col("type") == S.MESSAGE_ITEM))


def session_payloads(items: DataFrame) -> DataFrame:
    """JSON requests of the session summary items."""
    return item_payloads(items.where(F.col("type") == S.SESSION_ITEM))


# ---------------------------------------------------------------------------
# reading
# ---------------------------------------------------------------------------


def parse_payloads(raw: DataFrame, column: str = "value", *, tolerant: bool = True) -> DataFrame:
    """Parse JSON text by its tag.

    ``tolerant`` reads refused text a second time, in Arrow batches in which all other rows are NULL; without it
    such rows are parse errors and everything stays in the JVM.

    Adds ``is_json``, ``event_type`` and, by tag, the typed ``message_request`` or
    ``session_request``. ``read`` holds the texts and broken rules found on the way, for
    :func:`validate_payloads`; text is parsed, looked up and checked in one expression.
    """
    if tolerant:
        first = F.struct(F.col(column).alias("text"), F.try_parse_json(column).alias("variant"))
        read = _with_once(raw, "_first", first)
        refused = F.when(F.col("_first.variant").isNull(), F.col("_first.text"))
        read = read.withColumn("_again", _rewritten(refused))
        payload = F.coalesce("_first.variant", F.try_parse_json("_again"))
        parsed = _with_once(read, "read", _let(payload, _read_payload)).drop("_first", "_again")
    else:
        parsed = _with_once(raw, "read", _let(F.try_parse_json(column), _read_payload))
    tag = F.col("read.event_type")
    requests = {
        name: F.when(tag == event, _request(PAYLOAD_FIELDS[event]))
        for event, name in _REQUEST_COLUMN.items()
    }
    return parsed.withColumns({"is_json": F.col("read.is_json"), "event_type": tag, **requests})


#: A whole number that reads as an infinite double.
_INFINITE = 10**400


def _number(text: str) -> float | int:
    value = float(text)
    return value if abs(value) != float("inf") else _INFINITE if value > 0 else -_INFINITE


#: NaN is below no bound and equals nothing: every rule rejects it as it rejects minus infinity.
_CONSTANTS = {"NaN": -_INFINITE, "Infinity": _INFINITE, "-Infinity": -_INFINITE}


def rewritten(text: str) -> str | None:
    """The same document in strict JSON; None if it is none."""
    try:
        return json.dumps(json.loads(text, parse_float=_number, parse_constant=_CONSTANTS.get))
    except (ValueError, RecursionError):
        return None


def _rewritten(text: Column) -> Column:
    @F.arrow_udf("string")
    def again(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if column.null_count == len(column):
                yield pa.nulls(len(column), pa.string())
            else:
                yield pa.array([None if t is None else rewritten(t) for t in column.to_pylist()], pa.string())

    return again(text)


def _with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` and a column that is evaluated once for each row.

    A plain column is evaluated again in every filter on it and in every later column that names it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _read_payload(payload: Column) -> Column:
    def members(path: str) -> Column:
        return F.try_variant_get(payload, path, "map<string,variant>")

    def present(path: str) -> Column:
        return F.try_variant_get(payload, path, "variant").isNotNull()

    document = F.struct(
        payload.isNotNull().alias("is_json"),
        _string(payload, "event_type").alias("event_type"),
        _string(payload, "schema_version").alias("schema_version"),
        F.create_map(
            F.lit(""), members("$"),
            F.lit("session"), members("$.session"),
            F.lit("message"), members("$.message"),
            F.lit("features"), members("$.features"),
        ).alias("objects"),
        F.create_map(
            F.lit(""), present("$"),
            F.lit("session"), present("$.session"),
            F.lit("message"), present("$.message"),
            F.lit("features"), present("$.features"),
        ).alias("present"),
    )
    return _let(document, _read_document)


def _string(payload: Column, name: str) -> Column:
    """A top-level field, if it is a string."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(payload, f"$.{name}", "string"))


def _read_document(document: Column) -> Column:
    specs = {event: _spec(fields) for event, fields in PAYLOAD_FIELDS.items()}
    expected = _by_tag(document["event_type"], specs)

    def find(field: Column) -> Column:
        members = F.try_element_at(document["objects"], field["group"])
        return _let(
            F.try_element_at(members, field["name"]),
            lambda leaf: F.struct(
                field.alias("field"),
                members.isNotNull().alias("inside"),
                F.try_element_at(document["present"], field["group"]).alias("present"),
                F.schema_of_variant(leaf).alias("type"),
                F.try_variant_get(leaf, "$", "string").alias("text"),
            ),
        )

    def read(found: Column) -> Column:
        value = _value(found["field"]["kind"], found["type"], found["text"])
        return F.struct(
            *[found[c].alias(c) for c in ("field", "inside", "present", "type")],
            value.alias("value"),
        )

    fields = F.transform(F.transform(expected, find), read)
    return _let(
        fields,
        lambda found: F.struct(
            document["is_json"].alias("is_json"),
            document["event_type"].alias("event_type"),
            document["schema_version"].alias("schema_version"),
            F.transform(found, lambda field: field["value"]).alias("values"),
            _errors(document, found).alias("errors"),
        ),
    )


def _by_tag(tag: Column, choices: dict[str, Column]) -> Column:
    chosen = F.lit(None)
    for event, choice in choices.items():
        chosen = F.when(tag == event, choice).otherwise(chosen)
    return chosen


def _spec(fields: list[PayloadField]) -> Column:
    """The expected fields as a constant array, so that one lambda covers them all."""
    first = {field.group: at for at, field in reversed(list(enumerate(fields)))}
    return F.array(
        *[
            F.struct(
                F.lit(first[field.group] == at).alias("leads"),
                F.lit(field.group).alias("group"),
                F.lit(field.name).alias("name"),
                F.lit(field.kind).alias("kind"),
                F.lit(field.non_negative).alias("non_negative"),
            )
            for at, field in enumerate(fields)
        ]
    )


def _value(kind: Column, json_type: Column, text: Column) -> Column:
    """The value under the lenient rules, as plain text; NULL where it cannot be read."""
    is_text, is_flag = json_type == "STRING", json_type == "BOOLEAN"
    is_number = json_type.isin("BIGINT", "DOUBLE") | json_type.startswith("DECIMAL")
    trimmed = F.trim(text)
    digits = F.replace(trimmed, F.lit("_"), F.lit(""))
    flag_digit = F.when(text == "true", "1").otherwise("0")

    whole = (
        F.when(is_flag, flag_digit)
        .when(is_number | (is_text & trimmed.rlike(_INT_TEXT)), digits)
        .try_cast("decimal(38,6)")
    )
    integer = F.when(json_type == "BIGINT", text).when(  # a long is its own text
        whole == F.floor(whole), whole.cast("decimal(38,0)").cast("string")
    )
    is_float_text = is_text & (trimmed.rlike(_FLOAT_TEXT) | trimmed.rlike(_INFINITE_TEXT))
    real = F.when(is_number, text).when(is_flag, flag_digit).when(is_float_text, digits)
    word = F.when(is_number, text.try_cast("double").cast("bigint").cast("string")).when(
        is_text, F.lower(trimmed)
    )
    is_bit = ~is_number | text.try_cast("double").isin(0.0, 1.0)
    truth = (
        F.when(is_flag, text)
        .when(is_bit & word.isin(*_TRUE_TEXTS), "true")
        .when(is_bit & word.isin(*_FALSE_TEXTS), "false")
    )
    return (
        F.when(kind == "int", integer)
        .when(kind == "float", real)
        .when(kind == "bool", truth)
        .when(is_text, text)
    )


def _request(fields: list[PayloadField]) -> Column:
    groups: dict[str, list[Column]] = {}
    for at, field in enumerate(fields):
        value = F.get("read.values", F.lit(at))
        typed = value.try_cast(_SQL_TYPES[field.kind]).alias(field.name)
        groups.setdefault(field.group, []).append(typed)
    top = groups.pop("")
    return F.struct(
        F.col("read.schema_version").alias("schema_version"),
        F.col("read.event_type").alias("event_type"),
        *top,
        *[F.struct(*columns).alias(group) for group, columns in groups.items()],
    )


# ---------------------------------------------------------------------------
# checking
# ---------------------------------------------------------------------------


def validate_payloads(parsed: DataFrame) -> DataFrame:
    """Replace ``read`` by ``errors``: every broken rule as ``path:reason``, empty if good."""
    return parsed.withColumn("errors", F.col("read.errors")).drop("read")


def _errors(document: Column, found: Column) -> Column:
    good_version = F.coalesce(document["schema_version"] == S.SCHEMA_VERSION, F.lit(False))
    version_error = F.when(~good_version, "schema_version:unsupported")
    return (
        F.when(~document["is_json"], F.array(F.lit("payload:parse_error")))
        .when(found.isNull(), F.array(F.lit("event_type:unknown")))
        .otherwise(F.array_compact(F.concat(F.array(version_error), F.transform(found, _check))))
    )


def _check(read: Column) -> Column:
    field, value = read["field"], read["value"]
    path = F.concat_ws(".", F.when(field["group"] != "", field["group"]), field["name"])
    number = value.try_cast("double")
    reason = (
        F.when(read["type"].isNull(), "missing")
        .when(value.isNull(), "type")
        .when(field["non_negative"] & ((number < 0) | F.isnan(number)), "below_zero")
        .when((field["kind"] == "int") & value.try_cast("bigint").isNull(), "too_large")
    )
    # a missing or wrong object is reported once, not by its fields
    whole = F.when(~read["present"], ":missing").otherwise(":type")
    in_object = F.when(reason.isNotNull(), F.concat(path, F.lit(":"), reason))
    return F.when(read["inside"], in_object).when(field["leads"], F.concat(field["group"], whole))


def split_payloads(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted payloads, and rejected ones with their raw text and error codes."""
    accepted = validated.where(F.size("errors") == 0).drop("errors")
    rejected = validated.where(F.size("errors") > 0).drop("is_json", *_REQUEST_COLUMN.values())
    return accepted, rejected


def payload_vector(accepted: DataFrame) -> DataFrame:
    """``queue_sequence_id``, ``event_type``, ``names`` and ``values`` of accepted payloads."""
    is_message = F.col("event_type") == S.MESSAGE_EVENT
    return accepted.select(
        F.coalesce(
            "message_request.queue_sequence_id", "session_request.queue_sequence_id"
        ).alias("queue_sequence_id"),
        F.coalesce(
            "message_request.session.session_id", "session_request.session.session_id"
        ).alias("session_id"),
        "event_type",
        F.when(is_message, vector_names(S.MESSAGE_FEATURES))
        .otherwise(vector_names(S.SESSION_FEATURES))
        .alias("names"),
        F.when(is_message, vector(S.MESSAGE_FEATURES, "message_request.features."))
        .otherwise(vector(S.SESSION_FEATURES, "session_request.features."))
        .alias("values"),
    )


# ---------------------------------------------------------------------------
# the same range rules on snapshot columns, before any JSON is written
# ---------------------------------------------------------------------------


def snapshot_errors(snapshots: DataFrame, event: str) -> DataFrame:
    """Add ``errors`` for snapshot columns that would break a payload's lower bounds."""
    bounded = {
        field.name
        for field in PAYLOAD_FIELDS[event]
        if field.group and field.non_negative and field.name in snapshots.columns
    }
    checks = [
        F.when(~F.coalesce(F.col(name) >= 0, F.lit(False)) | F.isnan(name), f"{name}:below_zero")
        for name in snapshots.columns
        if name in bounded
    ]
    return snapshots.withColumn("errors", F.array_compact(F.array(*checks)))
