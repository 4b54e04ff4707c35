"""Payload round trip, every validation rule, logs."""

import copy
import json

from data import frame, golden

from sessora import schemas as S
from sessora.operators import events as E
from sessora.operators import items as I
from sessora.operators import payloads as J
from sessora.operators import vectors as V
from sessora.sources import payloads as files

MESSAGE = {
    "schema_version": "v1", "event_type": "message", "queue_sequence_id": 3,
    "timestamp": "2024-01-01T00:00:00.072000Z",
    "session": {"session_id": 7, "socket_handle": 1007, "logic_worker_id": 0,
                "connection_duration_ms": 72.0, "bytes_received_total": 120,
                "bytes_sent_total": 80, "error_count_total": 2},
    "message": {"request_index": 3, "packet_id": 2, "packet_size": 20, "payload_size": 16,
                "message_interval_ms": 29.5},
    "features": {"packet_size": 20, "payload_size": 16, "connection_duration_ms": 72.0,
                 "message_interval_ms": 29.5, "bytes_received_total": 120,
                 "bytes_sent_total": 80, "error_count_total": 2},
}
SUMMARY = {
    "schema_version": "v1", "event_type": "session_summary", "queue_sequence_id": 4,
    "timestamp": "2024-01-01T00:00:00.100000Z",
    "session": {"session_id": 7, "socket_handle": 1007, "logic_worker_id": 0,
                "is_started": True, "is_closed": True, "connection_duration_ms": 100.0,
                "bytes_received_total": 120, "bytes_sent_total": 80, "recv_event_count": 1,
                "send_event_count": 1, "request_count": 3, "error_count": 2,
                "avg_message_interval_ms": 30.0, "last_error_code": 2,
                "last_error_message": "bad payload"},
    "features": {"connection_duration_ms": 100.0, "bytes_received_total": 120,
                 "bytes_sent_total": 80, "recv_event_count": 1, "send_event_count": 1,
                 "request_count": 3, "error_count": 2, "avg_message_interval_ms": 30.0},
}


def changed(payload, path, *value):
    """A copy with one field set, or dropped if no value is given."""
    out = copy.deepcopy(payload)
    *groups, name = path.split(".")
    target = out
    for group in groups:
        target = target[group]
    if value:
        target[name] = value[0]
    else:
        del target[name]
    return out


def check(spark, payloads):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    raw = spark.createDataFrame(list(enumerate(texts)), "n int, value string").coalesce(1)
    rows = J.validate_payloads(J.parse_payloads(raw)).select("n", "errors").collect()
    return [r.errors for r in sorted(rows, key=lambda r: r.n)]


def cases():
    """(payload, expected errors) for every rule of every field."""
    free = {"session.logic_worker_id", "message.packet_id"}
    for payload in (MESSAGE, SUMMARY):
        yield payload, []
        for field in J.PAYLOAD_FIELDS[payload["event_type"]]:
            path, kind = field.path, field.kind
            yield changed(payload, path), [f"{path}:missing"]
            yield changed(payload, path, None), [f"{path}:type"]
            yield changed(payload, path, []), [f"{path}:type"]
            if kind in ("int", "float"):
                below = [] if path in free else [f"{path}:below_zero"]
                for value, expected in ((-1, below), (0, []), (1, []), ("12", []), (True, [])):
                    yield changed(payload, path, value), expected
                yield changed(payload, path, "x"), [f"{path}:type"]
            if kind == "int":
                yield changed(payload, path, 12.0), []
                yield changed(payload, path, 12.5), [f"{path}:type"]
                yield changed(payload, path, 2**63 - 1), []
                yield changed(payload, path, 2**63), [f"{path}:too_large"]
            if kind == "float":
                yield changed(payload, path, "1e3"), []
                yield changed(payload, path, "nan"), [f"{path}:type"]
            if kind == "bool":
                for value, expected in ((0, []), ("yes", []), (2, [f"{path}:type"])):
                    yield changed(payload, path, value), expected
            if kind == "str":
                yield changed(payload, path, 5), [f"{path}:type"]
        yield changed(payload, "schema_version", "v2"), ["schema_version:unsupported"]
        yield changed(payload, "schema_version"), ["schema_version:unsupported"]
        yield changed(payload, "event_type"), ["event_type:unknown"]
        yield changed(payload, "event_type", "other"), ["event_type:unknown"]
        yield changed(payload, "extra", 1), []
        for group in ("session", "features", "message")[: 3 if payload is MESSAGE else 2]:
            yield changed(payload, group), [f"{group}:missing"]
            for value in (None, 5, [], "x"):
                yield changed(payload, group, value), [f"{group}:type"]
        # what the strict parser refuses is read again
        for field in J.PAYLOAD_FIELDS[payload["event_type"]]:
            path, kind = field.path, field.kind
            infinite = [] if kind == "float" else [f"{path}:type"]
            nan = [f"{path}:below_zero"] if kind == "float" else [f"{path}:type"]
            yield json.dumps(changed(payload, path, float("inf"))), infinite
            yield json.dumps(changed(payload, path, float("nan"))), nan
            yield json.dumps(changed(payload, path, float("-inf"))), nan
        text = json.dumps(payload)
        assert text.startswith('{"schema_version": "v1"')
        yield text.replace('"v1"', '"v0", "schema_version": "v1"', 1), []
        yield text.replace('"v1"', '"v1", "schema_version": "v0"', 1), ["schema_version:unsupported"]
        yield text.replace('"session": {', '"session": 3, "session": {"session_id": -1, '), []
        yield text[:-1] + ', "extra": NaN, "more": 1e999, "text": "Infinity"}', []
    yield "not json", ["payload:parse_error"]
    yield "NaN", ["event_type:unknown"]
    yield "[" * 100_000, ["payload:parse_error"]
    yield "", ["payload:parse_error"]
    yield "[1]", ["event_type:unknown"]
    two = changed(changed(MESSAGE, "session.session_id", -1), "features.packet_size")
    yield two, ["session.session_id:below_zero", "features.packet_size:missing"]


def test_validation_matrix(spark):
    payloads, expected = zip(*cases())
    for payload, want, got in zip(payloads, expected, check(spark, payloads)):
        assert got == want, (payload, want, got)


def test_a_null_body_and_the_strict_reader(spark):
    raw = spark.createDataFrame([(None,), ('{"event_type": NaN}',)], "value string")
    found = J.validate_payloads(J.parse_payloads(raw)).select("errors").collect()
    assert [r.errors for r in found] == [["payload:parse_error"], ["event_type:unknown"]]
    strict = J.validate_payloads(J.parse_payloads(raw, tolerant=False))
    assert [r.errors for r in strict.select("errors").collect()] == [["payload:parse_error"]] * 2
    assert "Python" not in strict._jdf.queryExecution().executedPlan().toString()


def golden_items(spark):
    log = frame(spark, golden())
    return I.sequence_items(I.items_from_events(log), E.emitting_events(log))


def test_round_trip_and_vectors(spark):
    items = golden_items(spark)
    written = J.item_payloads(items)
    union = J.message_payloads(items).unionByName(J.session_payloads(items))
    assert sorted(map(str, written.collect())) == sorted(map(str, union.collect()))
    parsed = J.validate_payloads(J.parse_payloads(written.select("value")))
    accepted, rejected = J.split_payloads(parsed)
    assert rejected.count() == 0
    through_json = {r.queue_sequence_id: (r.event_type, r.names, r["values"])
                    for r in J.payload_vector(accepted).collect()}
    direct = {r.queue_sequence_id: (r.event_type, r.names, r["values"])
              for r in V.item_vector(items).collect()}
    assert through_json == direct
    assert direct[6][2] == [20.0, 16.0, 72.0, 29.5, 120.0, 80.0, 2.0]
    assert direct[7][2] == [100.0, 120.0, 80.0, 1.0, 1.0, 3.0, 2.0, 30.0]
    first = json.loads(J.session_payloads(items).where("queue_sequence_id = 7").first().value)
    assert first["timestamp"] == SUMMARY["timestamp"]
    assert first["features"] == SUMMARY["features"]


def test_files(spark, tmp_path):
    lines = [json.dumps(MESSAGE), json.dumps(SUMMARY), "oops"]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    raw = files.scan_payloads(spark, str(tmp_path / "in.txt"))
    accepted, rejected = J.split_payloads(J.validate_payloads(J.parse_payloads(raw)))
    assert [(r.value, r.errors) for r in rejected.collect()] == [("oops", ["payload:parse_error"])]
    files.write_payload_log(accepted, str(tmp_path / "payloads"))
    files.write_vector_log(J.payload_vector(accepted), str(tmp_path / "vectors"))
    logged = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "payloads")).collect()]
    assert sorted(logged, key=lambda p: p["queue_sequence_id"]) == [MESSAGE, SUMMARY]
    vectors = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "vectors")).collect()]
    assert {tuple(v["names"]) for v in vectors} == {S.MESSAGE_FEATURES, S.SESSION_FEATURES}


def test_a_filter_does_not_read_the_text_again(spark):
    texts = [json.dumps(MESSAGE), json.dumps(changed(MESSAGE, "session.session_id", -1)), "oops"]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    for tolerant, readings in ((False, 1), (True, 2)):
        parts = J.split_payloads(J.validate_payloads(J.parse_payloads(raw, tolerant=tolerant)))
        for part, rows in zip(parts, (1, 2)):
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count(".parseJson(") == readings
            assert part.count() == rows
