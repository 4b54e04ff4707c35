"""Ordered folds over groups of any size.

A *fold* summarises the rows of a group seen so far, in a fixed order: a sum,
the first or last non-null value, and so on. Every fold here is associative, so
a group can be cut into consecutive chunks, each chunk folded on its own, and
the chunk results combined. :func:`running` uses that to give one group to many
tasks, and :func:`final` to let Spark aggregate partially before the shuffle.

How :func:`running` treats a group that holds a third of the table:

1. *Split points.* A fixed hash of the order key picks a few rows per chunk, in
   one pass; of the picked keys of a group, in order, every n-th becomes a split
   point. Groups too small to reach n get none. The hash depends on the row
   alone, so a retried task cuts at the same places.
2. *Local fold.* Rows are shuffled once by ``(keys, chunk)``, sorted once, and
   folded by a window inside the chunk.
3. *Carry.* For split groups only, one summary row per chunk is aggregated
   (partial aggregation, tiny shuffle), and a window over the summary rows
   gives each chunk the fold of everything before it.
4. The carry is broadcast and added to the local result.

Both broadcast tables hold about an entry for each :data:`ROWS_PER_CHUNK` rows of
the data: 250,000 of them, some 10 MB, for 10 ** 12 rows. Chunks do not grow with
the data. No pass sorts or counts the sample in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Target rows of one chunk of a split group.
ROWS_PER_CHUNK = 1 << 22

#: Sampled keys per chunk; more makes chunk sizes more even, and the lists of keys longer.
_SAMPLES_PER_CHUNK = 4

CHUNK = "_chunk"

_GAP = "_gap"
_CARRY = "_carry"


@dataclass(frozen=True)
class Where:
    """A named row condition. Folds under one name share one aggregate in :func:`final`."""

    name: str
    condition: Column | None = None

    def only(self, value: Column) -> Column:
        return value if self.condition is None else F.when(self.condition, value)


EVERY_ROW = Where("every_row")


@dataclass(frozen=True)
class Fold:
    """One running value over the rows where ``where`` holds.

    ``value`` must not be NULL on those rows. The value is NULL, or 0 for a sum, until the
    first such row.

    kinds:
      sum       running total
      first     first value
      last      last value
      previous  last value of the rows *before* this one
      gap       ``name`` is the last value, ``name + '_gap'`` its difference to the value
                before it (NULL if there is none)
      current   the row's own value; as a final fold, the last row's
    """

    name: str
    kind: str
    value: Column
    where: Where = EVERY_ROW

    @property
    def outputs(self) -> list[str]:
        return [self.name, self.name + _GAP] if self.kind == "gap" else [self.name]

    @property
    def values(self) -> Column:
        """The value where the condition holds, else NULL."""
        return self.where.only(self.value)


# ---------------------------------------------------------------------------
# running form
# ---------------------------------------------------------------------------


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: Sequence[Fold],
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    same_rows: DataFrame | None = None,
    split_keys: Sequence[str] | None = None,
    split_rows: DataFrame | None = None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus one column per fold, as of each row in ``order`` within ``keys``.

    ``order`` must be unique within ``keys``. With no ``keys`` the whole table is one group.
    ``rows_per_chunk=None`` skips splitting, for callers that know every group fits one task.
    ``same_rows`` may give the same rows in a cheaper plan; split points and carries are
    then taken from it. ``split_keys`` and ``split_rows`` may place the split points by fewer
    keys and from yet another table; any points give the same result. ``seed`` gives the folds over
    earlier rows, as :func:`final` returns them; a group without a seed starts anew.
    """
    keys, order = list(keys), list(order)
    if seed is not None:
        here = running(df, keys, order, folds, rows_per_chunk, same_rows, split_keys, split_rows)
        return _after(here, seed, keys, [f for f in folds if f.kind != "current"], "left")
    if rows_per_chunk is None:
        if not keys:
            raise ValueError("the whole table as one group must be split: give rows_per_chunk")
        return _local(df, keys, order, folds)
    source = df if same_rows is None else same_rows
    split_by = keys if split_keys is None else list(split_keys)
    fences = _Fences(
        source if split_rows is None else split_rows, split_by, order, rows_per_chunk
    )
    local = _local(fences.assign(df), keys + [CHUNK], order, folds)
    carried = [f for f in folds if f.kind != "current"]
    if not carried:
        return local.drop(CHUNK)
    carry = _carry(fences.assign(source, split_groups_only=True), keys, order, carried)
    return _combine(local, carry, keys, carried)


def _local(df: DataFrame, group: list[str], order: list[str], folds: Sequence[Fold]) -> DataFrame:
    """Fold by windows that all share one exchange and one sort."""
    window = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    window = window.orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)

    columns: dict[str, Column] = {}
    gaps: dict[str, Column] = {}
    current: dict[str, Column] = {}
    for fold in folds:
        if fold.kind == "current":
            current[fold.name] = fold.value
        elif fold.kind == "sum":
            columns[fold.name] = F.coalesce(F.sum(fold.values).over(upto), F.lit(0))
        elif fold.kind == "first":
            columns[fold.name] = F.first(fold.values, ignorenulls=True).over(upto)
        elif fold.kind == "last":
            columns[fold.name] = F.last(fold.values, ignorenulls=True).over(upto)
        elif fold.kind == "previous":
            columns[fold.name] = F.last(fold.values, ignorenulls=True).over(before)
        elif fold.kind == "gap":
            columns[fold.name] = F.last(fold.values, ignorenulls=True).over(upto)
            columns[fold.name + _GAP] = fold.values - F.last(fold.values, ignorenulls=True).over(before)
            gaps[fold.name + _GAP] = F.last(fold.name + _GAP, ignorenulls=True).over(upto)
        else:
            raise ValueError(f"unknown fold kind {fold.kind!r}")
    # Place and sort the input columns before the window arguments are derived from
    # them, so that neither the shuffle nor the sort carries the derived columns.
    placed = df.repartition(*group) if group else df
    out = placed.sortWithinPartitions(*group, *order).withColumns(columns)
    if gaps:
        out = out.withColumns(gaps)
    return out.withColumns(current) if current else out


class _Fences:
    """Split points of the groups of one table, and the chunk of a row among them."""

    def __init__(
        self, source: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int
    ) -> None:
        if rows_per_chunk < 1:
            raise ValueError("rows_per_chunk must be at least 1")
        self.keys, self.order = keys, order
        every = max(1, rows_per_chunk // _SAMPLES_PER_CHUNK)
        step = max(1, rows_per_chunk // every)

        sample = source.select(*keys, *order)
        if every > 1:
            sample = sample.where(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
        points = F.sort_array(F.collect_list(F.struct(*order)))
        grouped = sample.groupBy(*keys).agg(points.alias("_points"))
        kept = F.filter("_points", lambda _, i: i % step == step - 1)
        thinned = grouped.select(*keys, kept.alias("_points")).where(F.size("_points") > 0)
        self.table = thinned.select(*keys, _searched(F.col("_points")).alias("_fences"))

    def assign(self, df: DataFrame, split_groups_only: bool = False) -> DataFrame:
        """Add ``CHUNK``: how many split points of its group lie at or before the row."""
        here = F.struct(*self.order)
        if self.keys:
            how = "inner" if split_groups_only else "left"
            fenced = _join_null_safe(df, self.table, self.keys, how)
            return fenced.withColumn(CHUNK, _chunk(F.col("_fences"), here)).drop("_fences")
        # The scalar is named once, above plain columns only (hence the explode): Spark then reads it in place,
        # and no row carries all split points.
        placed = df.select("*", F.explode(F.array(here)).alias("_here"))
        fenced = placed.withColumn("_fences", self.table.scalar())
        return fenced.withColumn(CHUNK, _chunk(F.col("_fences"), F.col("_here"))).drop("_fences", "_here")


def _join_null_safe(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join a broadcast table by keys of which NULL is one value like any other."""
    named = small.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return df.join(F.broadcast(named), same, how).drop(*[f"_right_{k}" for k in keys])


def _searched(points: Column) -> Column:
    """Sorted points and the step widths of a binary search among them: powers of two, largest first."""
    bits = F.length(F.bin(F.size(points)))
    steps = F.transform(F.sequence(bits - 1, F.lit(0)), lambda e: F.pow(F.lit(2), e).cast("int"))
    return F.struct(points.alias("points"), steps.alias("steps"))


def _chunk(fences: Column, here: Column) -> Column:
    """How many of the points lie at or before the row; 0 without points."""

    def among(found: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            return F.when(F.get(found["points"], at + width - 1) <= here, at + width).otherwise(at)

        return F.aggregate(found["steps"], F.lit(0), step)

    counted = F.get(F.transform(F.array(fences), among), F.lit(0))
    return F.coalesce(counted, F.lit(0))


def _carry(
    split: DataFrame, keys: list[str], order: list[str], folds: Sequence[Fold]
) -> DataFrame:
    """Per chunk of a split group, from its second on: each fold over all earlier chunks.

    A chunk continues at most one group of the chunk before it, so there are no more rows
    than split points.
    """
    summary = final(split, keys + [CHUNK], order, folds)
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns: dict[str, Column] = {}
    gaps: list[str] = []
    for fold in folds:
        name = fold.name
        if fold.kind == "sum":
            columns[name + _CARRY] = F.sum(name).over(earlier)
        elif fold.kind == "first":
            columns[name + _CARRY] = F.first(name, ignorenulls=True).over(earlier)
        else:
            columns[name + _CARRY] = F.last(name, ignorenulls=True).over(earlier)
        if fold.kind == "gap":
            # a chunk with one value has its gap to the last value of an earlier chunk
            gaps.append(name + _GAP)
            before = F.last(name, ignorenulls=True).over(earlier)
            columns[name + _GAP] = F.when(
                F.col(name).isNotNull(), F.coalesce(name + _GAP, F.col(name) - before)
            )
    out = summary.withColumns(columns)
    if gaps:
        out = out.withColumns(
            {gap + _CARRY: F.last(gap, ignorenulls=True).over(earlier) for gap in gaps}
        )
    carried = [output + _CARRY for fold in folds for output in fold.outputs]
    continued = out.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") > 1)
    return continued.select(*keys, CHUNK, *carried)


def _combine(
    local: DataFrame, carry: DataFrame, keys: list[str], folds: Sequence[Fold]
) -> DataFrame:
    joined = _join_null_safe(local, carry, keys + [CHUNK], "left")
    extra = [output + _CARRY for fold in folds for output in fold.outputs]
    return joined.withColumns(_combined(folds)).drop(CHUNK, *extra)


def _combined(folds: Sequence[Fold]) -> dict[str, Column]:
    """Each fold over the carried rows and then these."""
    columns: dict[str, Column] = {}
    for fold in folds:
        mine, earlier = F.col(fold.name), F.col(fold.name + _CARRY)
        if fold.kind == "sum":
            columns[fold.name] = mine + F.coalesce(earlier, F.lit(0))
        elif fold.kind == "first":
            columns[fold.name] = F.coalesce(earlier, mine)
        else:
            columns[fold.name] = F.coalesce(mine, earlier)
        if fold.kind == "gap":
            gap = fold.name + _GAP
            columns[gap] = F.when(mine.isNull(), F.col(gap + _CARRY)).otherwise(
                F.coalesce(F.col(gap), mine - earlier)
            )
    return columns


def _after(
    here: DataFrame, seed: DataFrame, keys: Sequence[str], folds: Sequence[Fold], how: str
) -> DataFrame:
    """Folds of ``here`` continued from those of ``seed``, one row for each group.

    Spark chooses the join: many groups shuffle, and an adaptive skew join splits a hot one.
    """
    outputs = [output for fold in folds for output in fold.outputs]
    named = seed.select(
        *[F.col(k).alias(f"_seed_{k}") for k in keys],
        *[F.col(output).alias(output + _CARRY) for output in outputs],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_seed_{k}")) for k in keys]
    joined = here.join(named, same, how)
    own = {f.name: F.coalesce(F.col(f.name), F.lit(0)) for f in folds if f.kind == "sum"}
    group = {k: F.coalesce(F.col(k), F.col(f"_seed_{k}")) for k in keys}
    out = joined.withColumns(own | group).withColumns(_combined(folds))
    return out.drop(*[f"_seed_{k}" for k in keys], *[output + _CARRY for output in outputs])


# ---------------------------------------------------------------------------
# final form
# ---------------------------------------------------------------------------


def final(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: Sequence[Fold],
    seed: DataFrame | None = None,
) -> DataFrame:
    """One row per group with every fold over the whole group.

    With ``seed``, an earlier result of this function, over the earlier rows too; groups of either are kept.

    All folds aggregate partially before the shuffle, so a hot group costs one
    row per map task. ``keys`` must not be empty.
    """
    keys = list(keys)
    sums = [fold for fold in folds if fold.kind == "sum"]
    ends: dict[tuple[str, str], list[Fold]] = {}
    for fold in folds:
        if fold.kind != "sum":
            end = "first" if fold.kind == "first" else "last"
            ends.setdefault((end, fold.where.name), []).append(fold)

    aggregates = [F.coalesce(F.sum(f.values), F.lit(0)).alias(f.name) for f in sums]
    columns = [F.col(f.name) for f in sums]
    for (end, name), group in ends.items():
        values = F.struct(*order, *[f.value.alias(f.name) for f in group])
        extreme = F.min if end == "first" else F.max
        aggregates.append(extreme(group[0].where.only(values)).alias(f"_{end}_{name}"))
        columns += [F.col(f"_{end}_{name}")[f.name].alias(f.name) for f in group]
    out = df.groupBy(*keys).agg(*aggregates).select(*keys, *columns)
    for fold in folds:
        if fold.kind == "gap":
            second = _second_last(df, keys, order, fold)
            out = out.join(second, keys, "left")
            out = out.withColumn(fold.name + _GAP, F.col(fold.name) - F.col("_second")).drop("_second")
    if seed is not None:
        return _after(out, seed, keys, folds, "full")
    return out


def _second_last(
    df: DataFrame, keys: list[str], order: Sequence[str], fold: Fold
) -> DataFrame:
    """The value before the last one.

    Spark applies the rank limit before the shuffle too, so a hot group sends two
    rows per map task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return (
        df.select(*keys, *order, fold.values.alias("_second"))
        .where(F.col("_second").isNotNull())
        .withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") == 2)
        .select(*keys, "_second")
    )
