"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   table folder, default /root/testdata/sf0.1
BENCH_CPUS     local threads, default 8
BENCH_COPIES   replicate the events with shifted session ids, default 1
BENCH_HOT      1: every session id divisible by 3 becomes session 2, about a third of all rows
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from oracle import queries as Q
from sessora import schemas as S
from sessora.operators import events as E
from sessora.operators import items as I
from sessora.operators import results as Z
from sessora.operators import running as R
from sessora.operators import scoring as C
from sessora.operators import snapshots as N
from sessora.operators import vectors as V
from sessora.sources.adapter import adapt_events

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
HOT = os.environ.get("BENCH_HOT", "0") == "1"
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def log_copy(spark: SparkSession, folder: str) -> DataFrame:
    """The adapted event log as files, replicated or skewed if asked for."""
    log = adapt_events(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    if COPIES > 1:
        copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
        log = log.withColumn("copy", copy).withColumns(
            {
                "session_id": F.col("session_id") + F.col("copy") * 10_000_000,
                "event_seq": F.col("event_seq") + F.col("copy") * 10_000_000_000,
            }
        ).drop("copy")
    if HOT:
        third = F.col("session_id") % 3 == 0
        log = log.withColumn("session_id", F.when(third, 2).otherwise(F.col("session_id")))
    log.repartition(int(CPUS)).write.parquet(folder)
    return E.normalize_events(spark.read.schema(S.NETWORK_EVENTS).parquet(folder))


def scored_messages(log: DataFrame) -> DataFrame:
    return C.score_constant(V.message_vector(R.message_snapshots(log)))


def result_state(log: DataFrame) -> DataFrame:
    results = scored_messages(log).select(
        "session_id",
        F.col("event_seq").alias("arrival_seq"),
        F.col("message_wall_time").alias("received_wall_time"),
        F.col("event_seq").cast("string").alias("request_id"),
        *["label", "is_attack", "confidence", "model_version"],
        F.col("event_type").alias("received_event_type"),
    )
    return Z.inference_session_state(results)


def numbered(log: DataFrame) -> DataFrame:
    return I.sequence_items(I.items_from_events(log), E.emitting_events(log))


def batch_queries(log: DataFrame) -> dict:
    offered = E.emitting_events(log).select(*S.ORDER)
    model = C.ThresholdModel()
    return {
        "running_session_state": lambda: R.running_session_state(log),
        "running_session_state_unsplit": lambda: R.running_session_state(log, rows_per_chunk=None),
        "session_snapshots": lambda: N.session_snapshots(log),
        "message_snapshots": lambda: R.message_snapshots(log),
        "vector_and_constant_score": lambda: scored_messages(log),
        "pandas_model_score": lambda: C.score_with(
            V.message_vector(R.message_snapshots(log)), model
        ),
        "flagship_result_state": lambda: result_state(log),
        "sequence_positions": lambda: I.sequence_items(offered),
        "sequence_items": lambda: numbered(log),
        "admit_items": lambda: I.admit_items(offered, Q.CAPACITY, I.hour_of()),
    }


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    folder = Q.run_folder(spark)
    log = log_copy(spark, f"{folder}/log")
    seconds = {}
    for name, query in batch_queries(log).items():
        run(query())  # compiles the plan once, as a long-running job has
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(query())
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    if COPIES == 1 and not HOT:
        start = time.perf_counter()
        run(Q.stream_feature_items(spark, SF_DIR))
        seconds["stream_feature_items"] = round(time.perf_counter() - start, 3)
    rows = log.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "events": rows,
                "copies": COPIES,
                "hot": HOT,
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
