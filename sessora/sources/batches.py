"""A table written batch by batch, of which readers see whole batches only.

A writer is a run with numbered batches, as a streaming query is. Each batch is a folder below ``run=<id>``; the
file that Spark leaves there when its job is done marks it as committed, so what a killed writer left
behind is never read. Batches are merged in levels: ``fan_out`` neighbours become one folder, ``fan_out`` of those
the next, so that after n batches a reader opens fewer than ``fan_out`` folders a level, of log(n)
levels. With ``newest_by`` a merge keeps the newest row of each key, and the table's size follows the
keys, not the batches; without it, a merge only makes large files of small ones. ``fan_out=None`` never merges, which
a table needs that a stream reads by its files.

A merged folder holds its batches once, and what it covers goes at the next merge, so a reader that has
listed the table just before still finds its files. A batch that is written again is the same batch (a
stream replays the same rows) and is left alone once merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FAN_OUT = 10
BATCH = "batch_id"

_PART = re.compile(r"batch_id=(\d+)(?:-(\d+))?")
_COMMITTED = "_SUCCESS"


@dataclass(frozen=True, order=True)
class Part:
    """Batches ``first`` to ``last`` in one folder."""

    first: int
    last: int

    @property
    def name(self) -> str:
        return f"batch_id={self.first}" + (f"-{self.last}" if self.last > self.first else "")

    def inside(self, other: Part) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last


def run_folder(path: str, run: str) -> str:
    if not run or "/" in run:
        raise ValueError("a run id must be a plain name")
    return f"{path}/run={run}"


class BatchTable:
    """One run's part of a table at ``path``."""

    def __init__(
        self, spark: SparkSession, path: str, run: str, newest_by: Sequence[str] = (), fan_out: int | None = FAN_OUT
    ) -> None:
        if fan_out is not None and fan_out < 2:
            raise ValueError("fan_out must be at least 2")
        self.spark, self.folder = spark, run_folder(path, run)
        self.newest_by, self.fan_out = list(newest_by), fan_out

    def write(self, batch: DataFrame, number: int) -> None:
        """Commit a batch, then merge where a level is full."""
        covering = [p for p in self.parts() if p.first <= number <= p.last and p.first < p.last]
        if not covering:
            marked = batch.withColumn(BATCH, F.lit(number).cast("long")) if self.newest_by else batch
            self._save(marked, Part(number, number))
        if self.fan_out is None:
            return
        width = self.fan_out
        while (number + 1) % width == 0:
            self._merge(Part(number + 1 - width, number), width // self.fan_out)
            width *= self.fan_out

    def parts(self) -> list[Part]:
        """Committed folders, merged ones and those they cover."""
        return [part for part, done in self._listed() if done]

    def cover(self) -> list[Part]:
        """The fewest committed folders that hold every committed batch once."""
        parts = self.parts()
        return sorted(p for p in parts if not any(p.inside(o) for o in parts))

    def newest(self) -> int | None:
        """The last committed batch."""
        return max((p.last for p in self.parts()), default=None)

    def paths(self, upto: int | None = None) -> list[str]:
        return [f"{self.folder}/{p.name}" for p in self.cover() if upto is None or p.last <= upto]

    def _merge(self, whole: Part, width: int) -> None:
        inside = [p for p in self.cover() if p.inside(whole)]
        if not inside:  # merged before
            return
        rows = self.spark.read.parquet(*[f"{self.folder}/{p.name}" for p in inside])
        self._save(newest_rows(rows, self.newest_by) if self.newest_by else rows, whole)
        older = [p for p in self.parts() if p != whole and not p.inside(whole)]
        for part, _ in self._listed():
            if any(part.inside(o) for o in older):
                self._remove(part)

    def _save(self, rows: DataFrame, part: Part) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part.name}")

    # a shared folder may be any file system that Spark reads, so its own client lists and deletes

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _listed(self) -> list[tuple[Part, bool]]:
        fs, folder = self._files()
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            match = _PART.fullmatch(status.getPath().getName())
            if match:
                part = Part(int(match[1]), int(match[2] or match[1]))
                _, mark = self._files(f"{part.name}/{_COMMITTED}")
                found.append((part, fs.exists(mark)))
        return found

    def _remove(self, part: Part) -> None:
        fs, path = self._files(part.name)
        fs.delete(path, True)


def newest_rows(rows: DataFrame, keys: Sequence[str], version: str = BATCH) -> DataFrame:
    """For each key the row of the highest version; combined before the shuffle."""
    others = [c for c in rows.columns if c not in (*keys, version)]
    newest = F.max_by(F.struct(*others), F.col(version)).alias("_row")
    merged = rows.groupBy(*keys).agg(F.max(version).alias(version), newest)
    return merged.select(*keys, version, "_row.*").select(*rows.columns)


def runs(spark: SparkSession, path: str) -> list[str]:
    """The runs that have written to a table, in the order of their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """All committed rows of all runs with the column ``run``; None if there are none and no schema is given."""
    found = None
    for run in runs(spark, path):
        paths = BatchTable(spark, path, run).paths()
        if paths:
            reader = spark.read if schema is None else spark.read.schema(schema)
            rows = reader.parquet(*paths).withColumn("run", F.lit(run))
            found = rows if found is None else found.unionByName(rows)
    if found is None and schema is not None:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(""))
    return found


def batch_writer(table: BatchTable, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """A ``foreachBatch`` function."""
    return lambda batch, number: table.write(shape(batch), number)
