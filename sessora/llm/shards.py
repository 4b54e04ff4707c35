"""Shards of nearly equal size, as ranges of a sorted key cut at sampled splitters.

1. *Sample.* Rows are drawn by a hash of their key with a chance that grows with their size, about
   :data:`SAMPLES` for each range; quantiles of the drawn weight are the boundaries of the ranges.
2. *Ranges.* Every row gets its range by binary search; one grouped sum tells what each holds. A range
   with more than twice its share, of bytes or of rows, is drawn from again and cut further, until
   none is left or one single row is the surplus.
3. *Places.* Inside its range each row gets the bytes and rows before it; those of the ranges before
   come from the grouped sums. Only here rows move, once, and no task gets more than a range.
4. *Shards* are equal stretches of all bytes, so the law is `bytes`: the sampled boundaries decide how the work
   is dealt, the exact sums decide what is cut where. Two shards differ by one row and what follows.

The key is the digest of the text, then the id: equal texts are neighbours. A group of equal texts
across a boundary stays whole if that moves the boundary by :data:`SLACK` of a shard at most; a larger
one, as a group of a third of all rows must be, is cut there. Equal rows are told apart by a row number, so that
a range of nothing but equal rows can be cut too.

The driver gets the sample and a row for each range, both bounded by rows / :data:`RANGE_ROWS`: 12,500 ranges
and 200,000 keys for 5 * 10^10 rows.

Size is the bytes of the text in UTF-8 plus 1; a null text has none, and is a neighbour of the empty
one. A null id sorts before others. Rows equal in id and text may swap their places. An empty table gives an empty
result. Only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sessora.llm.common import stored

SHARDS = 8
#: Rows of one range; fewer where the table is small, so that there are some ranges for each shard.
RANGE_ROWS = 4_000_000
RANGES_PER_SHARD = 8
#: Drawn rows for each range.
SAMPLES = 16
#: Part of a shard by which a boundary may move to keep equal texts together.
SLACK = 0.01

_KEY_BYTES = 33


def _bytes(value: Column) -> Column:
    """A long as eight bytes that sort as it does."""
    flipped = value.bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def keyed(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the digest of the text, the sort key, and the columns `keep`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    known = F.when(doc_id.isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
        F.concat(known, _bytes(F.coalesce(doc_id, F.lit(0)))).alias("_id"),
        F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"),
    )
    key = F.concat("digest", "_id", _bytes(F.monotonically_increasing_id()))
    return rows.withColumn("key", key).drop("_id")


def _weight(rows: int, size: int) -> Column:
    """Share of all bytes and of all rows, half each: neither may fill a range."""
    return (F.col("size") / F.lit(float(size)) + F.lit(1.0 / rows)) / 2


def drawn(rows: DataFrame, weight: Column, chance: Column, seed: int) -> pd.DataFrame:
    """Keys of a sample and the weight that each stands for, in order."""
    luck = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    found = rows.select("key", weight.alias("weight"), chance.alias("chance"), luck.alias("luck"))
    some = found.where("luck < chance").select("key", (F.col("weight") / F.least("chance", F.lit(1.0))).alias("weight"))
    return some.toPandas().sort_values("key")


def quantiles(sample: pd.DataFrame, pieces: int) -> list[bytes]:
    """Keys that cut the weight of a sample into so many equal pieces."""
    if not len(sample):
        return []
    ahead = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(ahead, ahead[-1] * np.arange(1, pieces) / pieces)
    return [bytes(k) for k in sample["key"].iloc[np.minimum(at, len(sample) - 1)]]


def range_of(cuts: list[bytes]) -> Column:
    """The range of a row: how many boundaries are not above its key."""
    sorted_cuts = np.array(cuts, f"S{_KEY_BYTES}")

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        own = np.array(keys.tolist(), f"S{_KEY_BYTES}")
        return pd.Series(np.searchsorted(sorted_cuts, own, side="right"))

    return find("key")


def splitters(rows: DataFrame, n: int, size: int, ranges: int) -> tuple[list[bytes], list]:
    """Boundaries of ranges none of which holds more than twice its share, and what each range holds."""
    weight, share = _weight(n, size), 1.0 / ranges
    cuts = sorted(set(quantiles(drawn(rows, weight, weight * ranges * SAMPLES, 0), ranges)))
    for seed in count(1):
        held = rows.select("size", range_of(cuts).alias("range")).groupBy("range")
        held = held.agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.max(weight).alias("most")
        ).collect()
        full = {}
        for r in held:
            own = (r.size / size + r.rows / n) / 2
            if own > 2 * share and own - r.most > share:
                full[r.range] = int(np.ceil(own / share))
        if not full:
            return cuts, sorted(held, key=lambda r: r.range)
        inside = rows.withColumn("range", range_of(cuts)).where(F.col("range").isin(list(full)))
        sample = drawn(inside, weight, weight * ranges * SAMPLES, seed)
        ranks = np.searchsorted(np.array(cuts, f"S{_KEY_BYTES}"), np.array(sample["key"].map(bytes).tolist(), f"S{_KEY_BYTES}"), side="right")
        more = [k for r, pieces in full.items() for k in quantiles(sample[ranks == r], pieces)]
        cuts = sorted({*cuts, *more})


def placed(rows: DataFrame, cuts: list[bytes], held: list) -> DataFrame:
    """Rows with `at` and `nth`, the bytes and rows before them; one shuffle."""
    starts, at, nth = [], 0, 0
    for r in held:
        starts.append((r.range, at, nth))
        at, nth = at + r.size, nth + r.rows
    starts = rows.sparkSession.createDataFrame(starts, "range int, range_at long, range_nth long")
    in_range = Window.partitionBy("range").orderBy("key")
    so_far = in_range.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("range", range_of(cuts))
    local = found.withColumns(
        {"_at": F.sum("size").over(so_far) - F.col("size"), "_nth": F.row_number().over(in_range) - 1}
    )
    return local.join(F.broadcast(starts), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        "digest",
        "kept",
        (F.col("range_at") + F.col("_at")).alias("at"),
        (F.col("range_nth") + F.col("_nth")).alias("nth"),
    )


def boundaries(found: DataFrame, size: int, shards: int, slack: float = SLACK) -> list[int]:
    """Where the shards after the first begin, in bytes."""
    # one row at most for each boundary, and the extent of its group
    across = found.where(f"at > 0 and (at + size - 1) * {shards} div {size} > (at - 1) * {shards} div {size}")
    groups = found.join(F.broadcast(across.select("digest").distinct()), "digest", "left_semi")
    extents = groups.groupBy("digest").agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("size")).alias("high"))
    extents = sorted((r.low, r.high) for r in extents.collect())
    cuts = []
    for shard in range(1, shards):
        byte = -(-shard * size // shards)
        for low, high in extents:
            if low < byte < high:
                near = low if byte - low <= high - byte else high
                if abs(near - byte) * shards <= slack * size:
                    byte = near
                break
        cuts.append(byte)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in its shard) of every row, and the columns `keep`
    in a struct `kept`."""
    rows = stored(keyed(docs, keep))
    total = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    if not total.rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "kept")
    ranges = max(shards * RANGES_PER_SHARD, -(-total.rows // RANGE_ROWS))
    cuts, held = splitters(rows, total.rows, total.size, ranges)
    found = stored(placed(rows, cuts, held))
    starts = F.array(*[F.lit(b).cast("long") for b in boundaries(found, total.size, shards)])
    middle = F.col("at") + F.floor(F.col("size") / 2)
    dealt = found.withColumn("shard", F.size(F.filter(starts, lambda b: b <= middle)))
    first = dealt.groupBy("shard").agg(F.min("nth").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"), "kept"
    )
