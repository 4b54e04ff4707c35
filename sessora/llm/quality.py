"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

A document's statistics are standardised and mapped to random cosines, which approximate a Gaussian
kernel. Ridge weights come from normal equations that each partition sums for its own rows; only the
sums, of fixed size, meet. Two halves of the learned rows are summed apart, so that out-of-fold scores
choose the penalty and calibrate: isotonic regression over score bins maps a score to 0..1.

All labelled rows that may be learned are used, nothing is sampled. Null and empty texts have
statistics like any other (all zero) and get a score. Labels that are null, or have a null id, count
for nothing; a repeated label row counts again. Without a learned row, or with one class only, the
score is the share of good labels, 0.5 if there is none. Rows are independent; `labels`, `lang`,
`source` and `doc_id` are no inputs of a score.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import (
    bound_batches,
    checkpointed,
    codepoints,
    learned,
    map_texts,
    over_texts,
    texts_of,
)

MODULUS, HELD_OUT = 3, 1
COSINES = 192
BINS = 2048
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
SEED = 7

# Kinds of bytes: letter (all bytes of other scripts too), upper case, digit, white, stop marks, others.
_KINDS = np.zeros(256, np.intp)
for _kind, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:'\"-()", b"!?"), 1
):
    _KINDS[list(_chars)] = _kind
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and _KINDS[b] == 0]] = 7

STATISTICS = (
    *("chars", "words", "word_length", "upper", "digits", "lines", "marks", "shouts", "symbols"),
    *("distinct", "top_word", "repeats", "pairs", "long_words", "short_words", "odd_ends"),
    *("sentence_ends", "capitals", "all_capitals", "line_words", "same_lines"),
)
_ODD_END = re.compile(r"[^\w\s.,;:'\")\]](?=\s|$)")


def statistics(text: str) -> list[float]:
    """The values named in STATISTICS."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KINDS[data], minlength=8)
    n, chars = len(words), len(data)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.intp, n)
    points, lower = codepoints(text), codepoints(text.lower())
    changed = np.count_nonzero(points != lower) if len(points) == len(lower) else int(kinds[1])
    letters = max(1, int(kinds[0] + kinds[1]))
    lines = [line for line in text.split("\n") if line]
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    return [
        np.log1p(chars),
        np.log1p(n),
        lengths.mean(),
        changed / letters,
        kinds[2] / chars,
        np.log1p(len(lines)),
        kinds[5] / n,
        kinds[6] / n,
        kinds[7] / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        pairs,
        np.count_nonzero(lengths > 12) / n,
        np.count_nonzero(lengths <= 3) / n,
        len(_ODD_END.findall(text)) / n,
        text.count(".") / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isupper, words)) / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the cosines and a constant
    knots: np.ndarray  # raw score, and what it is worth
    worth: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        raw = cosines(values, self.mean, self.spread) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.worth), 0.0, 1.0)


def cosines(values: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    scaled = np.clip((values - mean) / spread, -6, 6)
    rng = np.random.RandomState(SEED)
    width = values.shape[1]
    frequencies = rng.normal(size=(width, COSINES)) / np.sqrt(width)
    shifts = rng.uniform(0, 2 * np.pi, COSINES)
    waves = np.sqrt(2 / COSINES) * np.cos(scaled @ frequencies + shifts)
    return np.concatenate([waves, np.ones((len(values), 1))], axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and `stats` of every row."""

    def start() -> Callable:
        return lambda texts, part: {"stats": [statistics(t) for t in texts]}

    return map_texts(docs, "stats array<double>", start)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATISTICS))


def normal_equations(known: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, np.ndarray]:
    """For each half, the sum over its rows of z z', z being cosines, constant and label."""
    size = COSINES + 2
    upper = np.triu_indices(size)

    def run(batches):
        sums = np.zeros((2, size, size))
        for batch in batches:
            label = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            z = np.concatenate([cosines(_rows(batch), mean, spread), label[:, None]], axis=1)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                sums[h] += z[half == h].T @ z[half == h]
        for h in (0, 1):
            if sums[h].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(upper[0]), h)), pa.array(np.arange(len(upper[0]))), pa.array(sums[h][upper])],
                    names=["half", "cell", "value"],
                )

    cells = known.select("stats", "quality", "half").mapInArrow(run, "half long, cell long, value double")
    total = cells.groupBy("half", "cell").agg(F.sum("value").alias("value")).toPandas()
    found = {h: np.zeros((size, size)) for h in (0, 1)}
    for h, part in total.groupby("half"):
        i, j = upper[0][part["cell"]], upper[1][part["cell"]]
        found[int(h)][i, j] = found[int(h)][j, i] = part["value"]
    return found


def solve(sums: np.ndarray, penalty: float) -> np.ndarray:
    left, right = sums[:-1, :-1], sums[:-1, -1]
    ridge = penalty * np.eye(len(left))
    ridge[-1, -1] = 1e-9  # the constant is free
    return np.linalg.solve(left + ridge, right)


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    """Of the rows behind the sums."""
    w = np.append(weights, -1.0)
    return float(w @ sums @ w)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence: neighbours that fall are pooled."""
    pools: list[list[float]] = []  # mean, weight, members
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            pools[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _out_of_fold(known: DataFrame, mean, spread, by_half: dict[int, np.ndarray]) -> DataFrame:
    """(bin, label, n, raw) sums of scores by the other half's weights."""

    def run(batches):
        for batch in batches:
            z = cosines(_rows(batch), mean, spread)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, z @ by_half[1], z @ by_half[0])
            place = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(raw), batch.column("quality").cast(pa.float64())],
                names=["bin", "raw", "label"],
            )

    scored = known.select("stats", "quality", "half").mapInArrow(run, "bin long, raw double, label double")
    return scored.groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labels that may be learned. Only statistics are joined and kept, not texts."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int")).where(
        F.col("quality").isNotNull() & learned(MODULUS, HELD_OUT)
    )
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("long")
    known = checkpointed(measured(texts_of(docs)).join(wanted, "doc_id").withColumn("half", half))
    width = len(STATISTICS)
    moments = known.agg(
        F.count("*").alias("n"),
        F.sum("quality").alias("good"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(width)],
    ).first()
    if moments.n < 2 or moments.good in (0, moments.n):
        share = moments.good / moments.n if moments.n else 0.5
        flat = np.zeros(width)
        return Model(flat, flat + 1, np.zeros(COSINES + 1), np.array([0.0]), np.array([share]))
    mean = np.array([moments[f"m{i}"] for i in range(width)])
    spread = np.array([moments[f"s{i}"] or 1.0 for i in range(width)]) + 1e-9
    sums = normal_equations(known, mean, spread)
    errors = {
        p: squared_error(sums[0], solve(sums[1], p)) + squared_error(sums[1], solve(sums[0], p))
        for p in PENALTIES
    }
    penalty = min(errors, key=errors.get)
    by_half = {h: solve(sums[h], penalty) for h in (0, 1)}
    bins = _out_of_fold(known, mean, spread, by_half).toPandas().sort_values("raw")
    worth = isotonic(bins["label"].to_numpy(), bins["n"].to_numpy(float))
    return Model(mean, spread, solve(sums[0] + sums[1], penalty), bins["raw"].to_numpy(), worth)


def score(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """Columns `keep`, score, predicted (1 from a score of 0.5) of every row."""

    def start() -> Callable:
        def step(texts, part):
            found = model.score(np.array([statistics(t) for t in texts]))
            return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

        return step

    return map_texts(docs, "score double, predicted int", start, keep)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model predicts to be good, with their columns as they are."""

    def start() -> Callable:
        return lambda texts: model.score(np.array([statistics(t) for t in texts])) >= 0.5

    bound_batches(docs.sparkSession)
    return docs.where(over_texts(F.col("text"), "boolean", start))
