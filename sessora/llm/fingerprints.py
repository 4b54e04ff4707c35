"""Document fingerprints: Lempel-Ziv phrases, their hashes' minimum per bin.

A text is parsed into LZ78 phrases: each is the shortest string not yet in the dictionary. The phrase
set is hashed; a fingerprint holds the smallest hash in each of BINS bins as four hex digits, `----`
where a bin has none. The likeness of two fingerprints is the share of equal bins among those that
either fills, which estimates the Jaccard similarity of the phrase sets; of two empty ones it is 1.

Each text is also fingerprinted after an edit: its last quarter of code points gives way to the start
of the next document's text. "Next" is by ascending doc_id, the first after the last, null ids before
all others. Rows with one id are ordered among themselves by text; each is the next one of the row
before it. Null texts are empty. A single row is its own next one.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import codepoints, slices, splitmix, texts_of

BINS = 128
DIGITS = 4
EMPTY = "-" * DIGITS
CHUNK_BYTES = 128 << 20  # of neighbours that one task sorts and walks; less where Spark's shuffles are finer
_NULL_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    def __init__(self):
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def hashes(self, points: np.ndarray, ends: list[int]) -> np.ndarray:
        """A hash of each phrase; phrases follow each other, `ends` are their exclusive ends."""
        if len(points) >= len(self.up):
            self.grow(2 * len(points) + 1)
        with np.errstate(over="ignore"):
            terms = (points.astype(np.uint64) + np.uint64(1)) * self.up[: len(points)]
            total = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
            stops = np.asarray(ends, np.intp)
            begins = np.append(0, stops[:-1]) if len(stops) else stops
            return splitmix((total[stops] - total[begins]) * self.down[begins])


class Phrases:
    """LZ78 phrases of a text, whose last quarter can be exchanged.

    A last phrase that is in the dictionary already adds nothing to the set and is left out.
    """

    def __init__(self, text: str):
        self.text, self.root = text, {}
        self.ends: list[int] = []  # of each phrase, exclusive
        self.parents: list[dict] = []  # the trie node that each phrase extends
        self._parse(text, 0)

    def _parse(self, text: str, at: int) -> None:
        node = root = self.root
        end, parent = self.ends.append, self.parents.append
        for i, char in enumerate(text[at:] if at else text, at + 1):
            child = node.get(char)
            if child is None:
                node[char] = {}
                parent(node)
                end(i)
                node = root
            else:
                node = child

    def exchange(self, changed: str, kept: int) -> None:
        """Go on with a text that has the first `kept` code points in common: phrases that end there stay."""
        stay = bisect.bisect_right(self.ends, kept)
        for k in range(len(self.ends) - 1, stay - 1, -1):
            del self.parents[k][self.text[self.ends[k] - 1]]
        del self.ends[stay:], self.parents[stay:]
        self.text = changed
        self._parse(changed, self.ends[-1] if stay else 0)


def signature(hashes: np.ndarray) -> str:
    """The fingerprint of a phrase set."""
    bins, values = (hashes >> np.uint64(57)).astype(np.intp), hashes & np.uint64((1 << 57) - 1)
    least = np.full(BINS, 1 << 57, np.uint64)
    np.minimum.at(least, bins, values)
    kept = splitmix(least) >> np.uint64(64 - 4 * DIGITS)  # of a small minimum the upper bits say little
    digits = kept.astype(">u2").tobytes().hex()
    if (least < 1 << 57).all():
        return digits
    full = (least < 1 << 57).tolist()
    return "".join(digits[DIGITS * i : DIGITS * (i + 1)] if f else EMPTY for i, f in enumerate(full))


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either fingerprint fills."""
    x, y = (np.frombuffer(s.encode(), f"S{DIGITS}") for s in (a, b))
    filled = (x != EMPTY.encode()) | (y != EMPTY.encode())
    return float((x == y)[filled].mean()) if filled.any() else 1.0


def _placed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows with `chunk` (consecutive by order) and `ahead`: the first id of each chunk is also sent
    to the chunk before it, that of the first chunk to the last one.

    The bounds come from ids alone; they are all that the driver sees, one for each chunk. Their number
    follows the bytes, with Spark's number of shuffle partitions as the least.
    """
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = keyed.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(found.rows, max(least, -(-(found.bytes or 0) // chunk_bytes))))
    ranged = keyed.select("key").repartitionByRange(parts, "key")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = np.array(sorted(r.key for r in firsts.collect()) or [0], np.int64)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        """Twice the chunk, plus one for its first id."""
        ids = keys.to_numpy()
        chunk = np.searchsorted(bounds, ids, side="right") - 1
        return pd.Series(2 * chunk + (bounds[chunk] == ids))

    chunks = len(bounds)
    chunk = F.col("place").bitwiseAND(F.lit(~1)) / 2
    own = F.struct(chunk.cast("long").alias("chunk"), F.lit(False).alias("ahead"))
    other = F.struct(
        ((chunk + chunks - 1) % chunks).cast("long").alias("chunk"), F.lit(True).alias("ahead")
    )
    sent = F.when(F.col("place") % 2 == 1, F.array(own, other)).otherwise(F.array(own))
    placed = keyed.withColumn("place", place("key")).withColumn("sent", F.explode(sent))
    return (
        placed.select("doc_id", "text", "sent.chunk", "sent.ahead", "key")
        .repartitionById(chunks, F.col("chunk").cast("int"))
        .sortWithinPartitions("chunk", "ahead", "key", F.xxhash64("text"))
    )


def fingerprint(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, the two fingerprints, near_edited, near_next.

    Texts are shuffled once, into chunks of neighbours, and walked as a stream.
    """
    result = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return _placed(texts_of(docs), chunk_bytes).mapInArrow(_walk, result)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the one after it in its chunk; rows come in order, chunk after chunk.

    Of the rows sent ahead only the first counts, and only as a neighbour.
    """
    powers, out = Powers(), []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    current, closed, held = None, False, None

    def print_of(phrases: Phrases) -> str:
        return signature(powers.hashes(codepoints(phrases.text), phrases.ends))

    def finish(doc_id, phrases: Phrases, own: str, following: str, their: str) -> None:
        text = phrases.text
        quarter = len(text) // 4
        kept = len(text) - quarter
        changed = text[:kept] + following[:quarter]
        phrases.exchange(changed, kept)
        edited = print_of(phrases)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc_id, len(text), digest, own, edited, likeness(own, edited), likeness(own, their)))

    gc.disable()  # tries are trees without cycles, and many
    try:
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "chunk", "ahead")]
            for doc_id, text, chunk, ahead in zip(*columns):
                if chunk != current:
                    current, closed, held = chunk, False, None
                if closed:
                    continue
                phrases = Phrases(text)
                own = print_of(phrases)
                if held is not None:
                    finish(*held, text, own)
                held, closed = (doc_id, phrases, own), ahead
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                out.clear()
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    finally:
        gc.enable()
