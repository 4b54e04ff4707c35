"""The folds of :mod:`sessora.plans.folds` on a stream, with what came before kept as state.

Groups share buckets, and a bucket's rows of a micro-batch are folded together: sorted once by
group and order, then every fold is one segmented scan over the whole bucket in numpy. Nothing runs
row by row or group by group in Python. The JVM evaluates which rows a fold reads and with what value, so the
rules live in one place for batch and stream.

State of a bucket is its carry: for each group the folds after its last row, as one Arrow record batch. It
is read and written once per bucket and micro-batch, so with many idle groups in a bucket a batch rewrites more
than it changes, and with few the cost of a call is shared by few. Some hundred live groups per bucket
are a fair size; ``buckets=None`` keeps each group by itself. The number is part of the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sessora.plans.folds import Fold

BUCKETS = 256

#: Stands for NULL in columns of longs, which pandas would else turn into floats.
NONE = -(1 << 63)

_KEY, _CLEARS, _SEEN, _REMOVED, _EMIT = "_key", "_clears", "_seen", "_removed", "_emit"


def stream_running(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    folds: Sequence[Fold],
    *,
    emit: Column,
    removed: Column,
    keep: Sequence[str] = (),
    clears: Column | None = None,
    buckets: int | None = BUCKETS,
    idle_ms: int | None = None,
) -> DataFrame:
    """Rows where ``emit`` holds, with ``keep`` and one column per fold, as of the row.

    Within a micro-batch a group's rows count in ``order``, across micro-batches as they come. Rows
    where ``removed`` holds end their group; so does a row with more ``clears`` than the group has
    seen. With ``idle_ms`` a group without rows for that long (processing time) is dropped.
    ``current`` folds are the row's own columns: name these in ``keep`` instead.
    """
    folds = [f for f in folds if f.kind != "current"]
    types = {f.name: df.select(f.value.alias("v")).schema["v"].dataType for f in folds}
    kept = {c: df.schema[c].dataType for c in (*order, *keep)}
    values = [_plain(F.when(~removed, f.values), types[f.name]).alias(f.name) for f in folds]
    group = F.coalesce(F.col(key).cast("long"), F.lit(NONE))
    bucket = group if buckets is None else F.pmod(F.xxhash64(group), F.lit(buckets))
    rows = df.select(
        bucket.alias("_bucket"),
        group.alias(_KEY),
        (F.lit(0) if clears is None else clears).cast("long").alias(_CLEARS),
        F.coalesce(removed, F.lit(False)).alias(_REMOVED),
        F.coalesce(emit & ~removed, F.lit(False)).alias(_EMIT),
        *[_plain(F.col(c), t).alias(c) for c, t in kept.items()],
        *values,
    )
    specs = [Spec(f.name, f.kind, isinstance(types[f.name], T.StringType)) for f in folds]
    names = [output for f in folds for output in f.outputs]
    output_types = {output: types[f.name] for f in folds for output in f.outputs}
    schema = T.StructType(
        [T.StructField(c, _carrier(t)) for c, t in ({key: T.LongType()} | kept).items()]
        + [T.StructField(c, _carrier(output_types[c])) for c in names]
    )
    processor = _Processor(key, list(order), list(kept), specs, idle_ms)
    timeout = "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    found = rows.groupBy("_bucket").applyInPandasWithState(processor, schema, "carry binary", "append", timeout)
    restored = {key: df.schema[key].dataType} | kept | output_types
    return found.select(*[_restored(c, t).alias(c) for c, t in restored.items()])


def _carrier(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.StringType) else T.LongType()


def _plain(value: Column, kind: T.DataType) -> Column:
    """A value as pandas can hold it exactly."""
    if isinstance(kind, T.StringType):
        return value
    number = F.unix_micros(value) if isinstance(kind, T.TimestampType) else value.cast("long")
    return F.coalesce(number, F.lit(NONE))


def _restored(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.col(name)
    number = F.nullif(F.col(name), F.lit(NONE))
    return F.timestamp_micros(number) if isinstance(kind, T.TimestampType) else number.cast(kind)


# ---------------------------------------------------------------------------
# segmented scans
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    text: bool

    @property
    def outputs(self) -> list[str]:
        return [self.name, self.name + "_gap"] if self.kind == "gap" else [self.name]

    @property
    def nothing(self):
        return None if self.text else 0 if self.kind == "sum" else NONE


@dataclass(frozen=True)
class Segments:
    """Consecutive rows of one group and life. ``base`` is the place of its carry, -1 for a new one."""

    start: np.ndarray  # of each row's segment, by row
    number: np.ndarray
    first: np.ndarray  # of each segment
    base: np.ndarray  # by row

    def carried(self, carry: np.ndarray | None, nothing) -> np.ndarray:
        """What each row's segment has from before."""
        if carry is None or not len(carry):
            return np.full(len(self.base), nothing, object if nothing is None else np.int64)
        return np.where(self.base >= 0, carry[np.maximum(self.base, 0)], nothing)

    def at_last(self, values: np.ndarray, mask: np.ndarray, before: np.ndarray, *, skip: int = 0) -> np.ndarray:
        """For each row, the value at the last masked row of its segment so far, else ``before``."""
        place = np.arange(len(mask))
        last = np.maximum.accumulate(np.where(mask, place, -1))
        if skip:
            last = np.concatenate([[-1], last[:-1]])
        return np.where(last >= self.start, values[np.maximum(last, 0)], before)


def scan(spec: Spec, values: np.ndarray, segments: Segments, carry: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The fold as of every row, under the names of its outputs; `last` is what is carried on if it differs."""
    before = segments.carried(carry.get(spec.name), spec.nothing)
    mask = values != None if spec.text else values != NONE  # noqa: E711
    if spec.kind == "sum":
        total = np.cumsum(np.where(mask, values, 0))
        ahead = total - np.where(mask, values, 0)
        return {spec.name: total - ahead[segments.start] + before}
    if spec.kind == "first":
        place = np.arange(len(mask))
        found = np.minimum.reduceat(np.where(mask, place, len(mask)), segments.first)[segments.number]
        here = np.where(found <= place, values[np.minimum(found, len(mask) - 1)], spec.nothing)
        known = before != None if spec.text else before != NONE  # noqa: E711
        return {spec.name: np.where(known, before, here)}
    if spec.kind == "last":
        return {spec.name: segments.at_last(values, mask, before)}
    earlier = segments.at_last(values, mask, before, skip=1)
    latest = segments.at_last(values, mask, before)
    if spec.kind == "previous":
        return {spec.name: earlier, "last": latest}
    if spec.kind != "gap":
        raise ValueError(f"unknown fold kind {spec.kind!r}")
    apart = mask & (earlier != NONE)
    gaps = np.where(apart, values - np.where(apart, earlier, 0), NONE)
    gap = spec.name + "_gap"
    return {spec.name: latest, gap: segments.at_last(gaps, apart, segments.carried(carry.get(gap), NONE))}


def segments_of(
    groups: np.ndarray, removed: np.ndarray, clears: np.ndarray, known: np.ndarray, seen: np.ndarray
) -> tuple[Segments, np.ndarray]:
    """Segments of sorted rows, and the clears that each row's group has seen.

    ``known`` and ``seen`` are the groups of the carry, sorted, and their clears. Clears never fall
    within a group, as rows and clears are counted in one order.
    """
    n = len(groups)
    new_group = np.concatenate([[True], groups[1:] != groups[:-1]])
    place = np.searchsorted(known, groups)
    base = np.where((place < len(known)) & (known[np.minimum(place, len(known) - 1)] == groups), place, -1) if len(known) else np.full(n, -1)
    # the carry serves until the first removal
    gone = np.cumsum(removed) - removed
    base = np.where(gone > gone[np.maximum.accumulate(np.where(new_group, np.arange(n), 0))], -1, base)
    floor = np.where(base >= 0, seen[np.maximum(base, 0)], NONE) if len(known) else np.full(n, NONE)
    high = np.maximum(clears, floor)
    start = new_group | np.concatenate([[False], removed[:-1]])
    raised = np.concatenate([[False], high[1:] > high[:-1]]) & ~start
    at_start = new_group & (base >= 0) & (clears > floor)
    cleared = np.cumsum(raised | at_start)
    base = np.where(cleared > (cleared - (raised | at_start))[np.maximum.accumulate(np.where(new_group, np.arange(n), 0))], -1, base)
    start = start | raised
    first = np.flatnonzero(start)
    number = np.cumsum(start) - 1
    return Segments(first[number], number, first, base), high


# ---------------------------------------------------------------------------
# state of a bucket
# ---------------------------------------------------------------------------


class _Processor:
    """Folds a bucket's rows of a micro-batch onto its carry."""

    def __init__(self, key: str, order: list[str], kept: list[str], specs: list[Spec], idle_ms: int | None):
        self.key, self.order, self.kept, self.specs, self.idle_ms = key, order, kept, specs, idle_ms

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry = _opened(state.get[0]) if state.exists else {}
        now = 0 if self.idle_ms is None else state.getCurrentProcessingTimeMs()
        if carry and self.idle_ms is not None:
            carry = _taken(carry, np.flatnonzero(carry[_SEEN] > now - self.idle_ms))
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            out, carry = self.fold({c: rows[c].to_numpy() for c in rows.columns}, carry, now)
            yield out
        if carry and len(carry[_KEY]):
            state.update((_closed(carry),))
            if self.idle_ms is not None:
                state.setTimeoutDuration(int(max(1, carry[_SEEN].min() + self.idle_ms - now)))
        elif state.exists:
            state.remove()

    def fold(self, rows: dict, carry: dict, now: int) -> tuple[pd.DataFrame, dict]:
        ranks = np.lexsort([rows[c] for c in reversed([_KEY, *self.order])])
        rows = {c: v[ranks] for c, v in rows.items()}
        groups = rows[_KEY]
        none = np.zeros(0, np.int64)
        segments, clears = segments_of(
            groups, rows[_REMOVED], rows[_CLEARS], carry.get(_KEY, none), carry.get(_CLEARS, none)
        )
        last = np.flatnonzero(np.concatenate([groups[1:] != groups[:-1], [True]]))
        alive = last[~rows[_REMOVED][last]]
        emitted = np.flatnonzero(rows[_EMIT])
        out = {self.key: groups[emitted]} | {c: rows[c][emitted] for c in self.kept}
        new = {_KEY: groups[alive], _CLEARS: clears[alive], _SEEN: np.full(len(alive), now)}
        for spec in self.specs:
            found = scan(spec, rows[spec.name], segments, carry)
            for name in spec.outputs:
                out[name] = found[name][emitted]
                new[name] = found[name][alive]
            if "last" in found:
                new[spec.name] = found["last"][alive]
        return pd.DataFrame(out), _merged(carry, groups[last], new)


def _merged(carry: dict, touched: np.ndarray, new: dict) -> dict:
    """The carry with the touched groups' rows replaced, sorted by group."""
    if carry:
        rest = _taken(carry, np.flatnonzero(~np.isin(carry[_KEY], touched)))
        new = {c: np.concatenate([rest[c], v]) for c, v in new.items()}
    return _taken(new, np.argsort(new[_KEY], kind="stable"))


def _taken(carry: dict, places: np.ndarray) -> dict:
    return {c: v[places] for c, v in carry.items()}


def _closed(carry: dict) -> bytes:
    batch = pa.RecordBatch.from_pydict(
        {c: pa.array(v, pa.string() if v.dtype == object else pa.int64()) for c, v in carry.items()}
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes) -> dict:
    table = pa.ipc.open_stream(data).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}
