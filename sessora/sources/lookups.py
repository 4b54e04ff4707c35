"""Tables laid out for lookups by session id.

Rows are range-partitioned by the id and sorted, so every file and row group holds a short range of ids,
and their minima and maxima tell most of them apart from a wanted id. Bloom filters answer for the
ids that lie inside a range without being there. Both are read before any data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Of a row group: small enough to skip much, large enough to read well.
GROUP_BYTES = 8 << 20


def write_for_lookups(
    table: DataFrame, path: str, *, key: str = "session_id", files: int | None = None, group_bytes: int = GROUP_BYTES
) -> None:
    """Write ``table`` so that lookups by ``key`` read little of it. One sampled range exchange.

    ``files`` defaults to Spark's shuffle partitions. NULL ids come first, as one range; a hot id makes a large
    file, whose row groups still serve.
    """
    ranged = table.repartitionByRange(*([files] if files else []), F.col(key)).sortWithinPartitions(key)
    writer = ranged.write.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("parquet.block.size", str(group_bytes)).parquet(path)
