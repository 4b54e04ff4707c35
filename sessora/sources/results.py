"""The kept results table: parquet, written to by batch jobs and streams.

Each writer has a run id and numbers its batches (:mod:`sessora.sources.batches`), so a batch that is run
again replaces itself and nothing else, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessora import schemas as S
from sessora.sources.batches import BatchTable, read_batches

_COLUMNS = [f.name for f in S.INFERENCE_RESULT.fields]


def write_inference_results(
    results: DataFrame, path: str, run: str, batch_id: int = 0, *, fan_out: int | None = None
) -> None:
    """Keep a batch of results. The same run and batch number again replaces it.

    With ``fan_out``, so many batches become one folder; not for a table that a stream reads.
    """
    table = BatchTable(results.sparkSession, path, run, fan_out=fan_out)
    table.write(results.select(*_COLUMNS), batch_id)


def result_writer(path: str, run: str, fan_out: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. ``run`` names one checkpoint: a new checkpoint needs a new one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_inference_results(batch, path, run, batch_id, fan_out=fan_out)

    return write


def read_inference_results(spark: SparkSession, path: str) -> DataFrame:
    """Every batch that is committed."""
    return read_batches(spark, path, S.INFERENCE_RESULT).select(*_COLUMNS)
