"""What the text operators share: input columns, bounded Arrow slices, label folds, integer hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 256
SLICE_BYTES = 4 << 20
#: Of one Arrow batch; a task holds a few at a time, in the JVM and in Python.
BATCH_BYTES = 1 << 20

#: Columns to add for a slice of rows, by name, from its texts ('' for null) and the slice itself.
Step = Callable[[list[str], pa.RecordBatch], dict]


def texts_of(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no other column can clash with a result's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches to at most SLICE_ROWS rows and, but for single rows, `most` bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(False)
        first = 0
        while first < batch.num_rows:
            ahead = np.cumsum(sizes[first : first + SLICE_ROWS])
            rows = max(1, int(np.searchsorted(ahead, most, side="right")))
            yield batch.slice(first, rows)
            first += rows


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (but for single rows) in this session, if it allows larger ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Free memory of a Python worker that has done its task, for those that work next to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def over_texts(text: Column, kind: str, start: Callable[[], Callable[[list[str]], list]]) -> Column:
    """A value of DDL type `kind` for each text ('' for null); only the text goes through Python.

    `start` runs once per task and gives the function from a slice of texts to their values.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(f"value {kind}")).field(0).type

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = start()
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            cut = slices([batch], most=SLICE_BYTES // 4)
            parts = [pa.array(step(p.column(0).fill_null("").to_pylist()), arrow) for p in cut]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)
        del step
        give_back()

    return run(text.cast("string"))


def map_texts(
    frame: DataFrame, new: str, start: Callable[[], Step], keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Rows of `frame` with the columns `keep` and those of the DDL `new`.

    `start` runs once per task and gives the step that computes the new columns of a slice. The text
    is in column `text`; a step gets '' where it is null.
    """
    added = T._parse_datatype_string(new)
    schema = T.StructType([frame.schema[c] for c in keep] + added.fields)
    kept, arrow = list(keep), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for part in slices(batches):
            texts = part.column("text").fill_null("").to_pylist()
            columns = step(texts, part)
            made = [pa.array(columns[f.name], type=arrow.field(f.name).type) for f in added.fields]
            own = [part.column(c).cast(arrow.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays(own + made, schema=arrow)

    used = frame if "text" in kept else frame.select(*dict.fromkeys([*kept, "text"]))
    return used.mapInArrow(run, schema)


def fold(modulus: int, of: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % modulus


def held_out(modulus: int, remainder: int) -> Column:
    """Whether labels of this row must not be learned; false for a null id, which is never learned either."""
    return F.coalesce(fold(modulus) == remainder, F.lit(False))


def learned(modulus: int, remainder: int) -> Column:
    """Whether labels of this row may be learned."""
    return F.coalesce(fold(modulus) != remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one only where none is set."""
    spark_dir = spark.conf.get("spark.checkpoint.dir", None)
    if spark_dir is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        spark_dir = current.get() if current.isDefined() else None
    if spark_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark_dir = tempfile.mkdtemp(prefix="sessora-")
        spark.sparkContext.setCheckpointDir(spark_dir)
    return f"{spark_dir}/{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the shared checkpoint folder, with its lineage cut."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def stored(frame: DataFrame) -> DataFrame:
    """The frame, computed once into Parquet in the shared folder; its columns are read as needed."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def splitmix(values: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Cache:
    """A bounded memo in two generations: what was not used lately is dropped."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value
