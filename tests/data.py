"""Small event logs for tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from sessora import schemas as S

BASE = datetime(2024, 1, 1)

_GOLDEN = """
1 SessionStarted 7 0 0 -1 0 0 0
2 RecvCompleted 7 10 120 -1 0 0 0
3 PacketParsed 7 12 0 1 120 116 0
4 SendCompleted 7 15 80 -1 0 0 0
5 PacketParsed 7 42.5 0 1 60 56 0
6 ProtocolError 7 50 0 -1 0 0 10054 io failed
7 ProtocolError 7 60 0 9 33 0 2 bad payload
8 PacketParsed 7 72 0 2 20 16 0
9 SessionClosed 7 100 0 -1 0 0 0
10 RecvCompleted 7 130 5 -1 0 0 0
11 SessionStarted 7 200 0 -1 0 0 0
12 PacketParsed 7 210 0 1 30 26 0
13 SessionClosed 7 220 0 -1 0 0 0
14 RecvCompleted 8 5 40 -1 0 0 0
15 SessionClosed 8 25 0 -1 0 0 0
16 PacketParsed 0 30 0 1 10 6 0
17 PacketParsed 0 50 0 1 10 6 0
"""


def event(seq, kind, session, us, nbytes=0, pid=-1, psize=0, plsize=0, code=0, text=""):
    return {
        "event_seq": seq,
        "type": kind,
        "session_id": session,
        "socket_handle": 1000 + session,
        "logic_worker_id": seq % 3,
        "wall_time": BASE + timedelta(microseconds=us),
        "mono_us": us,
        "bytes_transferred": nbytes,
        "packet_id": pid,
        "packet_size": psize,
        "payload_size": plsize,
        "error_code": code,
        "error_message": text,
    }


def golden():
    rows = []
    for line in _GOLDEN.strip().splitlines():
        f = line.split(maxsplit=9)
        numbers = [int(x) for x in f[4:9]]
        text = f[9] if len(f) > 9 else ""
        rows.append(event(int(f[0]), f[1], int(f[2]), int(float(f[3]) * 1000), *numbers, text))
    return rows


def random_events(seed, n=400, sessions=4, hot=True, kinds=(*S.EVENT_KINDS, "Heartbeat")):
    """Random order, ties in time, unknown kinds; a third of all rows in session 2."""
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(10 * n), n):
        session = 2 if hot and rng.random() < 1 / 3 else rng.randrange(sessions)
        kind = rng.choice(kinds)
        size = rng.choice([0, 0, 7, 90])
        rows.append(
            event(
                seq,
                kind,
                session,
                rng.randrange(n) * 500,
                rng.randrange(2000),
                rng.choice([-1, 0, 3, 8]),
                size,
                max(0, size - 4),
                rng.randrange(5),
                f"e{rng.randrange(9)}" if kind == S.PROTOCOL_ERROR else "",
            )
        )
    return rows


def frame(spark, rows, schema=S.NETWORK_EVENTS):
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)
