"""Running and final session state against the row-by-row rules."""

import pytest
from data import event, frame, golden, random_events
from machine import replay

from sessora import schemas as S
from sessora.operators import epochs as P
from sessora.operators import running as R
from sessora.operators import snapshots as N
from sessora.operators.state import ALL_COLUMNS

CHUNKS = [None, 3, 40, R.ROWS_PER_CHUNK]


def same(actual, expected):
    for name in ("session_id", *ALL_COLUMNS):
        if name == "avg_message_interval_ms":
            assert actual[name] == pytest.approx(expected[name], rel=1e-12), name
        else:
            assert actual[name] == expected[name], (name, actual, expected)


@pytest.mark.parametrize("rows_per_chunk", CHUNKS)
def test_running_state_equals_replay(spark, rows_per_chunk):
    rows = golden() + [
        {**e, "event_seq": e["event_seq"] + 100_000, "session_id": e["session_id"] + 50}
        for e in random_events(1)
    ] + [{**e, "event_seq": e["event_seq"] + 200_000} for e in random_events(2)]
    state = R.running_session_state(frame(spark, rows), rows_per_chunk=rows_per_chunk)
    actual = {r["event_seq"]: r for r in state.collect()}
    expected = replay(rows)
    assert len(actual) == len(expected) == len(rows)
    for row in expected:
        same(actual[row["event_seq"]], row)


def test_golden_messages(spark):
    rows = R.message_snapshots(frame(spark, golden()), rows_per_chunk=4).collect()
    found = {
        r.event_seq: (r.session_id, r.request_index, r.connection_duration_ms,
                      r.message_interval_ms, r.bytes_received_total, r.bytes_sent_total,
                      r.error_count_total)
        for r in rows
    }
    assert found == {
        3: (7, 1, 12.0, 0.0, 120, 0, 0),
        5: (7, 2, 42.5, 30.5, 120, 80, 0),
        8: (7, 3, 72.0, 29.5, 120, 80, 2),
        12: (7, 4, 10.0, 138.0, 125, 80, 2),
        16: (0, 1, 0.0, 0.0, 0, 0, 0),
        17: (0, 2, 0.0, 20.0, 0, 0, 0),
    }


def test_golden_summaries(spark):
    rows = R.session_summaries(frame(spark, golden())).collect()
    found = {
        r.event_seq: (r.session_id, r.is_started, r.is_closed, r.connection_duration_ms,
                      r.bytes_received_total, r.recv_event_count, r.request_count,
                      r.error_count, r.avg_message_interval_ms, r.last_packet_id,
                      r.last_packet_size, r.last_payload_size, r.last_error_message)
        for r in rows
    }
    assert found == {
        9: (7, True, True, 100.0, 120, 1, 3, 2, 30.0, 2, 20, 16, "bad payload"),
        13: (7, True, True, 20.0, 125, 2, 4, 2, 66.0, 1, 30, 26, "bad payload"),
        15: (8, False, True, 20.0, 40, 1, 0, 0, 0.0, -1, 0, 0, ""),
    }


def test_snapshots_equal_last_running_row(spark):
    rows = random_events(3)
    last = {r["session_id"]: r for r in replay(rows)}
    snapshots = {r.session_id: r for r in N.session_snapshots(frame(spark, rows)).collect()}
    assert snapshots.keys() == last.keys()
    for sid, row in last.items():
        same(snapshots[sid], row)


def test_latest_messages_skip_silent_sessions(spark):
    rows = {r.session_id: r.event_seq for r in N.latest_messages(frame(spark, golden())).collect()}
    assert rows == {7: 12, 0: 17}


def test_session_zero_quirk_can_be_turned_off(spark):
    events = frame(spark, golden())
    rows = R.message_snapshots(events, session_zero_quirk=False).where("session_id = 0").collect()
    assert sorted(r.connection_duration_ms for r in rows) == [0.0, 20.0]


def test_request_index_is_gap_free(spark):
    rows = R.request_index(frame(spark, random_events(4)), rows_per_chunk=5).collect()
    by_session = {}
    for r in rows:
        by_session.setdefault(r.session_id, []).append(r.request_index)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_session.values())


def test_removals_and_clears(spark):
    rows = random_events(5, sessions=6)
    marks = [
        {**event(1_000_000 + i, S.REMOVE_SESSION, sid, us), "session_id": sid}
        for i, (sid, us) in enumerate([(2, 30_000), (2, 120_000), (1, 90_500), (77, 1)])
    ] + [{**event(2_000_000 + i, S.CLEAR, 0, us)} for i, us in enumerate([60_000, 150_250])]
    events = frame(spark, rows)
    controls = frame(spark, marks).select("type", "session_id", *S.ORDER)
    epochs = P.session_epochs(events, controls, rows_per_chunk=30)
    state = R.running_session_state(
        epochs, keys=P.EPOCH_KEYS, rows_per_chunk=30, split_rows=events
    )
    actual = {r["event_seq"]: r for r in state.collect()}
    expected = replay(rows + marks)
    assert len(actual) == len(expected)
    for row in expected:
        same(actual[row["event_seq"]], row)

    alive, gone = {}, []
    for row in sorted(rows + marks, key=lambda e: (e["mono_us"], e["event_seq"])):
        if row["type"] == S.CLEAR:
            alive.clear()
        elif row["type"] == S.REMOVE_SESSION:
            gone.append(alive.pop(row["session_id"], None))
        else:
            alive[row["session_id"]] = row["event_seq"]
    finals = {r.session_id: r for r in P.snapshots_with_removals(events, controls).collect()}
    assert finals.keys() == alive.keys()
    by_seq = {r["event_seq"]: r for r in expected}
    for sid, seq in alive.items():
        same(finals[sid], by_seq[seq])


def test_single_features_plan_only_their_columns(spark, tmp_path):
    frame(spark, golden()).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = R.running_error_count(events)._jdf.queryExecution().executedPlan().toString()
    assert "error_message" not in plan and "bytes_transferred" not in plan


def test_session_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, golden()).write.parquet(str(tmp_path / "e"))
    state = R.running_session_state(spark.read.parquet(str(tmp_path / "e")))
    plan = state.where("session_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,7)" in plan
