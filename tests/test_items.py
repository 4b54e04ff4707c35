"""Items, numbering, admission, packets, lookups, results, scoring."""

import pytest
from data import frame, golden, random_events
from pyspark.sql import functions as F

from sessora import schemas as S
from sessora.operators import events as E
from sessora.operators import items as I
from sessora.operators import lookups as L
from sessora.operators import packets as K
from sessora.operators import results as Z
from sessora.operators import running as R
from sessora.operators import scoring as C
from sessora.operators import snapshots as N
from sessora.operators import vectors as V
from sessora.plans import folds
from sessora.sources import results as sink
from sessora.functions.times import iso_utc
from sessora.sources.events import scan_network_events, scan_rejects


def test_golden_numbering(spark):
    log = frame(spark, golden())
    items = I.sequence_items(I.items_from_events(log), E.emitting_events(log), rows_per_chunk=2)
    rows = items.orderBy("queue_sequence_id").collect()
    assert [r.queue_sequence_id for r in rows] == list(range(1, 10))
    assert [r.event_seq for r in rows] == [3, 15, 16, 5, 17, 8, 9, 12, 13]


def test_one_pass_items_equal_the_union(spark):
    log = frame(spark, random_events(6))
    union = I.feature_items(R.message_snapshots(log), R.session_summaries(log))
    single = I.items_from_events(log).select(*union.columns)
    assert sorted(map(str, union.collect())) == sorted(map(str, single.collect()))


@pytest.mark.parametrize("samples", [1, 2, 64])
def test_numbering_is_exact_wherever_it_splits(spark, monkeypatch, samples):
    monkeypatch.setattr(folds, "_SAMPLES_PER_CHUNK", samples)
    log = frame(spark, random_events(7)).select(*S.ORDER)
    numbered = I.sequence_items(log, rows_per_chunk=3).collect()
    order = sorted(numbered, key=lambda r: (r.mono_us, r.event_seq))
    assert [r.queue_sequence_id for r in order] == list(range(1, len(order) + 1))


def test_admission(spark):
    log = frame(spark, random_events(8)).select(*S.ORDER)
    bucket = F.when(F.col("mono_us") < 150_000, 0).otherwise(1)
    rows = I.admit_items(log, 7, bucket, rows_per_chunk=20).collect()
    stats = {r.bucket: r for r in I.admission_stats(log, 7, bucket).collect()}
    for b in (0, 1):
        mine = sorted((r for r in rows if r.bucket == b), key=lambda r: (r.mono_us, r.event_seq))
        assert [r.bucket_position for r in mine] == list(range(1, len(mine) + 1))
        assert [r.admitted for r in mine] == [i < 7 for i in range(len(mine))]
        assert stats[b].offered == stats[b].admitted + stats[b].dropped == len(mine)
        assert stats[b].admitted == min(7, len(mine))
    with pytest.raises(ValueError):
        I.admit_items(log, 0, bucket)
    with pytest.raises(ValueError):
        I.admission_stats(log, 0, bucket)


def test_packet_outcome_looks_at_the_id_first(spark):
    rows = [(9, False, 5), (1, False, 0), (1, True, 2), (1, True, 0)]
    packets = spark.createDataFrame(rows, "packet_id int, decode_ok boolean, remaining_bytes int")
    found = [(r.outcome, r.closes_connection) for r in K.packet_outcome(packets, [1]).collect()]
    assert found == [
        ("unknown_id", False), ("malformed", True), ("trailing_bytes", True), ("ok", False)
    ]


def test_lookups_take_lists_and_frames(spark):
    snapshots = N.session_snapshots(frame(spark, golden()))
    ids = spark.createDataFrame([(7,), (99,)], "session_id bigint")
    for wanted in ([7, 99], ids, range(7, 4000)):
        found = {r.session_id for r in L.lookup_session_snapshots(snapshots, wanted).collect()}
        assert found == ({7, 8} if isinstance(wanted, range) else {7})
    assert {r.session_id for r in L.remove_sessions(snapshots, [7]).collect()} == {0, 8}
    assert {r.session_id for r in L.remove_sessions(snapshots, ids).collect()} == {0, 8}


def _results(spark, rows):
    full = [(s, a, None, str(a), "x", attack, 0.5, "m", "message") for s, a, attack in rows]
    return spark.createDataFrame(full, S.INFERENCE_RESULT)


def test_result_state_goes_by_arrival(spark):
    state = Z.inference_session_state(_results(spark, [(1, 5, True), (1, 2, False), (2, 3, False)]))
    rows = {r.session_id: r for r in state.collect()}
    assert rows[1].latest_result.arrival_seq == 5
    assert (rows[1].total_result_count, rows[1].attack_result_count) == (2, 1)
    assert rows[2].attack_result_count == 0


def test_result_sinks(spark, tmp_path):
    path = str(tmp_path / "results")
    for _ in range(2):  # a repeated batch replaces itself
        sink.write_inference_results(_results(spark, [(1, 1, False)]), path, "job")
        sink.result_writer(path, "first")(_results(spark, [(1, 2, True), (2, 3, True)]), 0)
    sink.result_writer(path, "second")(_results(spark, [(3, 4, True)]), 0)  # a new checkpoint
    assert sink.read_inference_results(spark, path).count() == 4


def test_malformed_lines_are_no_events(spark, tmp_path):
    good = '{"event_seq": 1, "mono_us": 5, "type": "RecvCompleted", "session_id": 9223372036854775807}'
    lines = [
        good,
        "not json at all",
        good.replace("9223372036854775807", "18446744073709551615").replace(": 1,", ": 2,"),
        '{"event_seq": 3, "session_id": 1}',
        '{"event_seq": "x", "mono_us": 5}',
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    path = str(tmp_path / "log.json")
    kept = scan_network_events(spark, path, "json").collect()
    assert [(r.event_seq, r.session_id) for r in kept] == [(1, 9223372036854775807)]
    reasons = [r.reason for r in scan_rejects(spark, path, "json").collect()]
    assert sorted(reasons) == ["corrupt", "corrupt", "no mono_us", "session_id too large"]


@pytest.mark.parametrize("extra", [0, 1100])
def test_lookups_do_not_depend_on_the_list(spark, extra):
    table = spark.createDataFrame([(None,), (1,), (2,)], "session_id bigint")
    more = list(range(100, 100 + extra))
    ids = lambda f: sorted([r.session_id for r in f.collect()], key=str)
    assert ids(L.remove_sessions(table, [1, *more])) == [2, None]
    assert ids(L.remove_sessions(table, [1, None, *more])) == [2, None]
    assert ids(L.lookup_session_snapshots(table, [1, None, *more])) == [1]
    assert ids(L.lookup_session_snapshots(table, more)) == []
    assert ids(L.remove_sessions(table, more)) == [1, 2, None]


def test_iso_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-01-01 00:00:00.072 UTC", "2024-03-31 02:30:00 UTC", "1999-12-31 23:59:59.999999 UTC"]
    try:
        for other in ("UTC", "Asia/Tokyo", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", other)
            rows = spark.createDataFrame([(t,) for t in texts], "t string")
            found = rows.select(iso_utc(F.col("t").cast("timestamp")).alias("t")).collect()
            assert [r.t for r in found] == [
                "2024-01-01T00:00:00.072000Z", "2024-03-31T02:30:00.000000Z", "1999-12-31T23:59:59.999999Z",
            ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_null_groups_are_split(spark):
    rows = spark.range(400).selectExpr("CASE WHEN id % 2 = 0 THEN 1 END AS k", "id AS at", "1 AS one")
    fences = folds._Fences(rows, ["k"], ["at"], 10)
    chunks = fences.assign(rows).groupBy("k").agg(F.countDistinct(folds.CHUNK).alias("n")).collect()
    assert len(chunks) == 2 and all(r.n > 5 for r in chunks)
    count = folds.Fold("n", "sum", F.col("one"))
    found = folds.running(rows, ["k"], ["at"], [count], 10).collect()
    assert all(r.n == r["at"] // 2 + 1 for r in found)
    with pytest.raises(ValueError):
        folds.running(rows, [], ["at"], [count], None)


def test_scan_has_the_fixed_schema(spark, tmp_path):
    for fmt in ("parquet", "json"):
        frame(spark, golden()).write.format(fmt).save(str(tmp_path / fmt))
        scanned = scan_network_events(spark, str(tmp_path / fmt), fmt)
        assert scanned.schema == S.NETWORK_EVENTS
        assert scanned.count() == 17


def test_models_agree(spark):
    messages = V.message_vector(R.message_snapshots(frame(spark, golden())))
    by_model = C.score_with(messages, C.ThresholdModel(limit=2))
    verdicts = {r.event_seq: (r.is_attack, r.confidence) for r in by_model.collect()}
    assert verdicts == {
        3: (False, 0.1), 5: (False, 0.1), 8: (True, 0.9), 12: (True, 0.9),
        16: (False, 0.1), 17: (False, 0.1),
    }


def test_responses_need_a_confidence_within_bounds(spark):
    rows = [(x,) for x in (0.0, 1.0, -0.1, 1.1, None, float("nan"))]
    responses = spark.createDataFrame(rows, "confidence double")
    assert C.validate_responses(responses).count() == 2
    assert C.invalid_responses(responses).count() == 4


def test_numbering_spreads_and_reads_split_points_in_place(spark):
    rows = spark.range(150_000).select(F.col("id").alias("mono_us"), (-F.col("id")).alias("event_seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge the tasks of so few rows
    try:
        numbered = I.sequence_items(rows).withColumn("task", F.spark_partition_id())
        found = numbered.agg(F.countDistinct("task"), F.sum((F.col("queue_sequence_id") != F.col("mono_us") + 1).cast("int")))
        tasks, wrong = found.first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks > 1 and wrong == 0
    plan = I.sequence_items(rows, rows_per_chunk=16)._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "scalar-subquery" in line]
    assert read and not any("AS _fences" in line for line in read)
