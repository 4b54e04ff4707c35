"""State continued from what earlier events left, and tables laid out for lookups."""

import random
import time

import pytest
from data import event, frame, random_events
from pyspark.sql import functions as F

from sessora import schemas as S
from sessora.operators import lookups as L
from sessora.operators import running as R
from sessora.operators import snapshots as N
from sessora.sources.lookups import write_for_lookups


def rows_of(frame, columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("cut", [0, 137, 300])
def test_continued_state_equals_state_of_everything(spark, cut):
    log = sorted(random_events(31, n=300), key=lambda e: (e["mono_us"], e["event_seq"]))
    log[5]["session_id"] = log[250]["session_id"] = None
    before, after, whole = (frame(spark, rows) for rows in (log[:cut], log[cut:], log))
    kept = R.kept_state(before)
    plain = R.running_session_state(whole)
    for options in ({}, {"rows_per_chunk": 16}):
        parts = R.running_session_state(before).unionByName(R.running_session_state(after, kept=kept, **options))
        assert rows_of(parts, plain.columns) == rows_of(plain, plain.columns)
    final = N.session_snapshots(whole)
    assert rows_of(N.snapshots_of_kept(R.kept_state(after, kept)), final.columns) == rows_of(final, final.columns)


def test_a_few_columns_from_kept_state(spark):
    log = [event(1, S.PACKET_PARSED, 4, 1_000), event(2, S.RECV_COMPLETED, 4, 2_000, 7)]
    later = [event(3, S.PACKET_PARSED, 4, 9_000), event(4, S.RECV_COMPLETED, 5, 9_500, 1)]
    kept = R.kept_state(frame(spark, log))
    found = R.running_session_state(frame(spark, later), ["request_count", "bytes_received_total"], kept=kept)
    assert {r.event_seq: (r.request_count, r.bytes_received_total) for r in found.collect()} == {3: (2, 7), 4: (0, 1)}


def rows_scanned(spark, frame):
    """Rows that the file scans of a plan gave to it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frame._jdf.queryExecution().executedPlan()
        frame._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(
            s.metrics().apply("numOutputRows").value() for s in scans if s.nodeName().startswith("Scan parquet")
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookups_skip_most_row_groups(spark, tmp_path):
    rng = random.Random(9)
    ids = [rng.randrange(10**9) * 2 for _ in range(60_000)]
    table = spark.createDataFrame([(i, "x" * 40) for i in ids], "session_id long, text string")
    table.repartition(8).write.parquet(f"{tmp_path}/plain")
    write_for_lookups(table, f"{tmp_path}/laid", files=40, group_bytes=1 << 16)
    wanted = rng.sample(sorted(set(ids)), 2)
    plain, laid = (L.lookup_session_snapshots(spark.read.parquet(f"{tmp_path}/{t}"), wanted) for t in ("plain", "laid"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, laid.collect()))
    assert rows_scanned(spark, laid) * 10 <= rows_scanned(spark, plain)
    # an id inside the range of every file that is nowhere
    nobody = L.lookup_session_snapshots(spark.read.parquet(f"{tmp_path}/laid"), [wanted[0] + 1])
    assert rows_scanned(spark, nobody) == 0


def test_a_million_ids_plan_in_seconds(spark):
    table = spark.range(100).select(F.col("id").alias("session_id"))
    began = time.time()
    found = L.lookup_session_snapshots(table, list(range(50, 1_000_050)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - began < 20 and len(plan) < 10_000
    assert found.count() == 50
