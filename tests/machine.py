"""The session rules, one event at a time: the yardstick for the set-based operators."""

from __future__ import annotations

from sessora import schemas as S


def replay(events):
    """State after every event; events are dicts, taken in ``(mono_us, event_seq)`` order."""
    sessions, out = {}, []
    for e in sorted(events, key=lambda e: (e["mono_us"], e["event_seq"])):
        sid = e["session_id"]
        if e["type"] == S.REMOVE_SESSION:
            sessions.pop(sid, None)
            continue
        if e["type"] == S.CLEAR:
            sessions.clear()
            continue
        s = sessions.setdefault(sid, _new())
        if s["session_id"] == 0:
            s["session_id"], s["start_us"] = sid, e["mono_us"]
            s["connection_start_wall_time"] = e["wall_time"]
        s["socket_handle"], s["logic_worker_id"] = e["socket_handle"], e["logic_worker_id"]
        s["last_event_wall_time"] = e["wall_time"]
        if e["type"] == S.SESSION_STARTED:
            s["is_started"], s["is_closed"] = True, False
            s["connection_start_wall_time"], s["start_us"] = e["wall_time"], e["mono_us"]
        s["connection_duration_ms"] = (e["mono_us"] - s["start_us"]) / 1000.0
        if e["type"] == S.SESSION_CLOSED:
            s["is_closed"], s["connection_close_wall_time"] = True, e["wall_time"]
        elif e["type"] == S.RECV_COMPLETED:
            s["recv_event_count"] += 1
            s["bytes_received_total"] += e["bytes_transferred"]
        elif e["type"] == S.SEND_COMPLETED:
            s["send_event_count"] += 1
            s["bytes_sent_total"] += e["bytes_transferred"]
        elif e["type"] == S.PACKET_PARSED:
            _message(s, e)
        elif e["type"] == S.PROTOCOL_ERROR:
            s["error_count"] += 1
            s["last_error_code"], s["last_error_message"] = e["error_code"], e["error_message"]
            if e["packet_id"] >= 0:
                s["last_packet_id"] = e["packet_id"]
            if e["packet_size"] > 0:
                s["last_packet_size"] = e["packet_size"]
            if e["payload_size"] > 0:
                s["last_payload_size"] = e["payload_size"]
        out.append({**s, "event_seq": e["event_seq"], "type": e["type"]})
    return out


def _message(s, e):
    s["request_count"] += 1
    s["last_packet_id"] = e["packet_id"]
    s["last_packet_size"], s["last_payload_size"] = e["packet_size"], e["payload_size"]
    gap = 0.0 if s["message_us"] is None else (e["mono_us"] - s["message_us"]) / 1000.0
    s["gap_sum"] += gap
    s["last_message_interval_ms"] = gap
    if s["request_count"] > 1:
        s["avg_message_interval_ms"] = s["gap_sum"] / (s["request_count"] - 1)
    s["message_us"] = e["mono_us"]


def _new():
    zeros = dict.fromkeys(f.name for f in S.SESSION_STATE.fields) | {
        "session_id": 0,
        "is_started": False,
        "is_closed": False,
        "last_packet_id": -1,
        "last_error_message": "",
        "message_us": None,
        "gap_sum": 0.0,
        "start_us": None,
    }
    wall = ("connection_start_wall_time", "last_event_wall_time", "connection_close_wall_time")
    return {k: 0 if v is None and k not in (*wall, "message_us", "start_us") else v
            for k, v in zeros.items()}
