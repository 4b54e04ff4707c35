"""Streams over several files and micro-batches against batch results and the row rules."""

import random
import time

import numpy as np
import pytest
from data import event, frame, random_events
from machine import replay
from pyspark.sql import functions as F

from sessora import schemas as S
from sessora.operators import items as I
from sessora.operators import results as Z
from sessora.sources.batches import BatchTable, Part, read_batches
from sessora.sources.events import stream_event_rows, stream_network_events
from sessora.sources.results import read_inference_results
from sessora.streaming import folds as XF
from sessora.streaming import ingest as XG
from sessora.streaming import numbering as XN
from sessora.streaming import scoring as XS
from sessora.streaming import sessions as XI


@pytest.fixture(scope="module")
def rows():
    return sorted(random_events(11, n=240), key=lambda e: (e["mono_us"], e["event_seq"]))


def stream_of(spark, folder, batches):
    """One file per micro-batch, in order."""
    import os
    import time

    XI.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # fixed per checkpoint; each one costs a worker
    at = time.time() - 1000
    for n, batch in enumerate(batches):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):  # a file stream takes files by modification time
            path = os.path.join(folder, name)
            if os.path.getmtime(path) > at + 500:
                os.utime(path, (at + n, at + n))
    return stream_network_events(spark, str(folder), max_files_per_trigger=1)


def run(spark, items, folder):
    query = XS.write_stream(items, f"{folder}/out", f"{folder}/cp", available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(items.schema).parquet(f"{folder}/out")


def test_items_equal_batch_when_in_order(spark, tmp_path, rows):
    stream = stream_of(spark, tmp_path / "in", [rows[:100], rows[100:101], rows[101:]])
    items = run(spark, XI.stream_feature_items(stream), tmp_path)
    batch = I.items_from_events(frame(spark, rows)).select(*items.columns)
    assert sorted(map(str, items.collect())) == sorted(map(str, batch.collect()))


def test_removal(spark, tmp_path, rows):
    middle = rows[120]["mono_us"]
    marks = [{**event(10**7, S.REMOVE_SESSION, 2, middle)}]
    mixed = sorted(rows + marks, key=lambda e: (e["mono_us"], e["event_seq"]))
    stream = stream_of(spark, tmp_path / "in", [mixed[:90], mixed[90:]])
    items = run(spark, XI.stream_feature_items(stream), tmp_path)
    messages = items.where("message IS NOT NULL").select("event_seq", "message.request_index")
    expected = {
        r["event_seq"]: r["request_count"] for r in replay(mixed) if r["type"] == S.PACKET_PARSED
    }
    assert {r.event_seq: r.request_index for r in messages.collect()} == expected


def test_late_batches_apply_as_they_come(spark, tmp_path):
    early = [event(1, S.PACKET_PARSED, 5, 10_000), event(2, S.SESSION_CLOSED, 5, 20_000)]
    late = [event(3, S.PACKET_PARSED, 5, 4_000), event(4, S.SESSION_CLOSED, 5, 30_000)]
    stream = stream_of(spark, tmp_path / "in", [early, late])
    rows = {r.event_seq: r for r in run(spark, XI.stream_feature_items(stream), tmp_path).collect()}
    assert rows[3].message.message_interval_ms == -6.0
    assert (rows[4].session.request_count, rows[4].session.avg_message_interval_ms) == (2, -6.0)


def test_scores_and_result_state(spark, tmp_path, rows):
    stream = stream_of(spark, tmp_path / "in", [rows[:80], rows[80:]])
    out = str(tmp_path / "results")
    query = XS.stream_score(stream, out, str(tmp_path / "cp"), run="one", available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    results = read_inference_results(spark, out)
    emitted = [r for r in rows if r["type"] in (S.PACKET_PARSED, S.SESSION_CLOSED)]
    assert results.count() == len(emitted)

    live = spark.readStream.schema(S.INFERENCE_RESULT).parquet(out)
    live = live.select(*S.INFERENCE_RESULT.fieldNames())
    query = XS.stream_inference_state(
        live, str(tmp_path / "state"), str(tmp_path / "cp2"), run="1", available_now=True
    )
    query.awaitTermination(300)
    kept = XS.read_inference_state(spark, str(tmp_path / "state"))
    batch = Z.inference_session_state(results).select(*kept.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, batch.collect()))


# --- folds by segmented scans


def folded(batches, specs, removed_clears, idle_ms=None):
    """Every row of the batches after :meth:`_Processor.fold`, keyed by its place."""
    processor, carry, out = XF._Processor("k", ["t"], ["t"], specs, idle_ms), {}, {}
    for batch in batches:
        rows = {
            XF._KEY: np.array([r[0] for r in batch], np.int64),
            "t": np.array([r[1] for r in batch], np.int64),
            XF._REMOVED: np.array([r[2] for r in batch], bool),
            XF._CLEARS: np.array([sum(c <= r[1] for c in removed_clears) for r in batch], np.int64),
            XF._EMIT: np.array([not r[2] for r in batch], bool),
        }
        for spec in specs:
            values = [None if r[2] or r[3] is None else (str(r[3]) if spec.text else r[3]) for r in batch]
            rows[spec.name] = (
                np.array(values, object) if spec.text else np.array([XF.NONE if v is None else v for v in values], np.int64)
            )
        frame, carry = processor.fold(rows, carry, 0)
        carry = XF._opened(XF._closed(carry)) if len(carry[XF._KEY]) else {}
        for row in frame.to_dict("records"):
            out[row["t"]] = row
    return out


def plainly(rows, specs, clears):
    lives, out = {}, {}
    for key, t, gone, value in rows:
        if gone:
            lives.pop(key, None)
            continue
        seen = sum(c <= t for c in clears)
        if key not in lives or lives[key][0] < seen:
            lives[key] = (seen, [])
        past = lives[key][1]
        before = [v for v in past if v is not None]
        past.append(value)
        known = [v for v in past if v is not None]
        row = {"k": key, "t": t}
        for spec in specs:
            shown = (lambda v: str(v)) if spec.text else (lambda v: v)
            none = spec.nothing
            if spec.kind == "sum":
                row[spec.name] = sum(known)
            elif spec.kind == "first":
                row[spec.name] = shown(known[0]) if known else none
            elif spec.kind == "previous":
                row[spec.name] = shown(before[-1]) if before else none
            else:
                row[spec.name] = shown(known[-1]) if known else none
            if spec.kind == "gap":
                row[spec.name + "_gap"] = known[-1] - known[-2] if len(known) > 1 else XF.NONE
        out[t] = row
    return out


@pytest.mark.parametrize("seed", range(12))
def test_scans_equal_plain_folds_at_any_cuts(seed):
    rng = random.Random(seed)
    kinds = [("a", "sum", False), ("b", "first", False), ("c", "last", False), ("d", "previous", False)]
    specs = [XF.Spec(*k) for k in [*kinds, ("e", "gap", False), ("f", "last", True), ("g", "first", True)]]
    rows = [
        (rng.choice([1, 1, 2, 3, XF.NONE]), t, rng.random() < 0.05, rng.choice([None, rng.randrange(9)]))
        for t in range(rng.choice([1, 40, 300]))
    ]
    clears = sorted(rng.sample(range(300), 3))
    cuts = sorted({0, len(rows), *[rng.randrange(len(rows)) for _ in range(rng.randrange(7))]})
    batches = []
    for low, high in zip(cuts, cuts[1:]):
        batches.append(rng.sample(rows[low:high], high - low))  # a batch comes in any order
    assert folded(batches, specs, clears) == plainly(rows, specs, clears)


def test_items_equal_batch_at_random_cuts(spark, tmp_path):
    log = sorted(random_events(23, n=300), key=lambda e: (e["mono_us"], e["event_seq"]))
    log[40]["session_id"] = log[200]["session_id"] = None
    cuts = [0, 1, 7, 120, 121, 300]
    parts = [frame(spark, log[a:b]) for a, b in zip(cuts, cuts[1:])]
    batch = I.items_from_events(frame(spark, log))

    def start(buckets):
        stream = stream_network_events(spark, f"{tmp_path}/in", max_files_per_trigger=None)
        items = XI.stream_feature_items(stream, buckets=buckets)
        return XS.write_stream(items, f"{tmp_path}/{buckets}", f"{tmp_path}/cp{buckets}", available_now=True)

    XG.replayed(parts, f"{tmp_path}/in", lambda: start(None))
    start(3).awaitTermination(120)  # all files at once
    for buckets in (None, 3):
        found = spark.read.schema(batch.schema).parquet(f"{tmp_path}/{buckets}").select(*batch.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))


def test_idle_sessions_start_anew_and_active_ones_go_on(spark, tmp_path):
    """A running trigger: session 1 rests for longer than allowed, session 2 sends all the time."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder, out, n = f"{tmp_path}/in", f"{tmp_path}/out", 0

    def put(*sessions):
        nonlocal n
        rows = [event(n + i, S.PACKET_PARSED, s, 1000 * (n + i)) for i, s in enumerate(sessions)]
        n += len(sessions)
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)

    put(1, 2)
    stream = stream_network_events(spark, folder, max_files_per_trigger=None)
    items = XI.stream_feature_items(stream, buckets=4, idle_ms=8_000)
    writer = items.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp")
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(no_data, "false")
    query = writer.trigger(processingTime="500 milliseconds").start()
    spark.conf.unset(no_data)
    try:
        query.processAllAvailable()
        for _ in range(4):
            time.sleep(3)
            put(2)
            query.processAllAvailable()
        put(1, 2)
        query.processAllAvailable()
        time.sleep(10)
        put(3)  # with the next batch, timers drop what rests, whatever its bucket
        query.processAllAvailable()
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]][-1]
        assert query.exception() is None
    finally:
        query.stop()
    found = spark.read.schema(items.schema).parquet(out).orderBy("event_seq").collect()
    index = {s: [r.message.request_index for r in found if r.message.session_id == s] for s in (1, 2)}
    assert index == {1: [1, 1], 2: [1, 2, 3, 4, 5, 6]}
    assert rows == 1


# --- tables written in batches


def test_many_batches_stay_few_folders(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "one", ["session_id"], fan_out=3)
    expected, listed = {}, []
    table._save = lambda rows, part, save=table._save: save(rows.coalesce(1), part)
    rng = random.Random(1)
    for number in range(34):
        ids = rng.sample(range(20), 3)
        expected |= {i: number for i in ids}
        table.write(spark.createDataFrame([(i, number) for i in ids], "session_id long, value int"), number)
        listed.append(len(table.cover()))
    assert max(listed) <= 4 * 2 and table.newest() == 33
    # folders on disk: those read, and at most what the last merges covered
    assert len(table.parts()) <= 2 * 3 + max(listed)
    kept = XS.newest_rows(read_batches(spark, str(tmp_path / "t")).drop("run"), ["session_id"])
    assert {r.session_id: r.value for r in kept.collect()} == expected
    table.write(spark.createDataFrame([(99, 99)], "session_id long, value int"), 5)  # merged: left alone
    assert XS.read_inference_state(spark, str(tmp_path / "t")).where("session_id = 99").count() == 0


def test_cover_of_many_batches():
    """The folders that a reader opens after n batches, without writing them."""

    class Dry(BatchTable):
        def __init__(self):
            self.spark, self.folder, self.newest_by, self.fan_out = None, "", ["k"], 10
            self.have = {}

        def _listed(self):
            return list(self.have.items())

        def _save(self, rows, part):
            self.have[part] = True

        def _merge(self, whole, width):
            inside = [p for p in self.cover() if p.inside(whole)]
            if inside:
                self._save(None, whole)
                older = [p for p in self.parts() if p != whole and not p.inside(whole)]
                self.have = {p: d for p, d in self.have.items() if not any(p.inside(o) for o in older)}

    table = Dry()
    rows = type("Rows", (), {"withColumn": lambda self, *a: self})()
    import sessora.sources.batches as B

    class Nothing:
        def lit(self, x):
            return type("C", (), {"cast": lambda s, t: None})()

    real, B.F = B.F, Nothing()
    try:
        for number in range(1000):
            table.write(rows, number)
            cover = table.cover()
            assert sum(p.last - p.first + 1 for p in cover) == number + 1
            assert len(cover) <= 27 and len(table.have) <= 27 + 30
    finally:
        B.F = real
    assert table.cover() == [Part(0, 999)]


def test_a_killed_writer_leaves_nothing_to_read(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "one", ["session_id"], fan_out=3)
    for number in range(2):
        table.write(spark.createDataFrame([(number, number)], "session_id long, value int"), number)

    def killed(rows, part):
        if part.first == part.last:
            BatchTable._save(table, rows, part)
        else:  # half a folder, without a mark
            rows.write.parquet(f"{table.folder}/{part.name}")
            (tmp_path / "t" / "run=one" / part.name / "_SUCCESS").unlink()
            raise RuntimeError("killed")

    table._save = killed
    batch = spark.createDataFrame([(2, 2)], "session_id long, value int")
    with pytest.raises(RuntimeError):
        table.write(batch, 2)
    del table._save
    assert len(table.cover()) == 3
    read = lambda: sorted(r.value for r in read_batches(spark, str(tmp_path / "t")).collect())
    assert read() == [0, 1, 2]
    table.write(batch, 2)  # the stream runs the batch again
    assert read() == [0, 1, 2] and table.cover() == [Part(0, 2)]


def test_numbers_follow_each_other_over_batches(spark, tmp_path, rows):
    items = I.items_from_events(frame(spark, rows)).select("mono_us", "event_seq", "type")
    expected = {r.event_seq: r.queue_sequence_id for r in I.sequence_items(items).collect()}
    cuts = sorted(r.mono_us for r in items.select("mono_us").collect())
    cuts = [-1, *[cuts[len(cuts) * i // 4] for i in (1, 2, 3)], 10**12]
    table = XN.NumberedItems(spark, str(tmp_path / "n"), "one")
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = items.where((F.col("mono_us") > low) & (F.col("mono_us") <= high))
        if number == 2:  # killed between the items and the ledger, then run again
            table.items.write(I.sequence_items(part).withColumn("queue_sequence_id", F.lit(-1).cast("long")), 2)
            assert table.read().where("queue_sequence_id < 0").count() == 0
        table.append(part, number)
        table.append(part, number)  # committed: left alone
    assert {r.event_seq: r.queue_sequence_id for r in table.read().collect()} == expected


def test_accepted_and_rejected_rows_are_all_rows(spark, tmp_path, rows):
    lines = [f'{{"event_seq": {i}, "mono_us": {i}, "session_id": 1, "type": "SessionStarted"}}' for i in range(40)]
    lines[3], lines[17], lines[30] = "no json", '{"event_seq": 17}', '{"mono_us": 1}'
    spark.createDataFrame([(line,) for line in lines], "value string").repartition(4).write.text(f"{tmp_path}/in")
    stream = stream_event_rows(spark, f"{tmp_path}/in", "json", max_files_per_trigger=1)
    start = lambda: XG.stream_split_events(stream, f"{tmp_path}/out", f"{tmp_path}/cp", run="one", available_now=True)
    for _ in range(2):  # the second finds nothing new
        query = start()
        query.awaitTermination(300)
        assert query.exception() is None
        accepted, rejected = (r(spark, f"{tmp_path}/out") for r in (XG.read_events, XG.read_rejects))
        assert (accepted.count(), rejected.count()) == (37, 3)
    assert {r.reason for r in rejected.collect()} == {"corrupt", "no mono_us", "no event_seq"}
