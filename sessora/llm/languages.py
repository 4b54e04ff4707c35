"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters in lower case, every run of other characters read as one blank.
Counts of 4-grams come from a sample of the learned rows, at most about `sample_chars` characters a
language, chosen in pieces of texts by a hash of the id and the piece's number, so that a long text counts like
many short ones; lower orders use continuation counts. All languages share sorted
arrays of n-gram hashes, with a log-probability per language in each row, so a text is looked up once.
The language of the lowest cross-entropy per character wins. Two calibrations use all learned rows outside the
sample, of which a share is kept for them: the score (0 to 1) is a logistic function of the distance to the second
language, and a text whose cross-entropy lies far above what its language shows is marked `rejected`. A language
with few such rows has the limit of all languages; with few in all, the limit is that of characters drawn blindly.

Null, empty and letterless texts are `und`, score 0, rejected. Texts are read whole, at any length.
Without a learned row every text is `und` and nothing is rejected. Rows are independent; ties go to
the language that sorts first. Rows with a null id, lang or text are never learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sessora.llm.common import (
    bound_batches,
    codepoints,
    learned,
    map_texts,
    over_texts,
    shared_folder,
    slices,
    splitmix,
)

ORDER = 4
MODULUS, HELD_OUT = 4, 2
SAMPLE_CHARS = 1_500_000  # a language, expected
CALIBRATION_SHARE = 1 / 8  # of the learned rows of a language of at least FEW_DOCS, never sampled
FEW_DOCS = 16
PIECE = 2_000  # characters that the sample takes or leaves
FEW_CHECKED = 20  # rows below which a language has no limit of its own
UNKNOWN = "und"
SHORT_TEXT = 10.0  # nats, over the root of a text's length: how far chance raises its cross-entropy
_BITS = 52
_BASE = np.uint64(0x100000001B3)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def stream(text: str) -> np.ndarray:
    """Codepoints that the models read: letters in lower case, other runs as a blank; no start blank."""
    points = codepoints(text.lower())
    letter = _letters()[points]
    points = np.where(letter, points, 0x20)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Streams of all texts, each after ORDER - 1 blanks, and the start of each."""
    blanks = np.full(ORDER - 1, 0x20, np.uint32)
    parts = [np.concatenate([blanks, stream(t)]) for t in texts]
    sizes = np.cumsum([0, *map(len, parts)])
    return np.concatenate(parts), sizes


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position; positions before a whole one hold nonsense."""
    values = points.astype(np.uint64)
    total = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(order - 1, -1, -1):
            moved = np.concatenate([np.zeros(back, np.uint64), values[: len(values) - back]])
            total = total * _BASE + moved + np.uint64(1)
    return splitmix(total) >> np.uint64(64 - _BITS)


class SortedHashes:
    """A sorted hash array with an index of its upper bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(8, min(20, len(hashes).bit_length() + 1))
        self.shift = np.uint64(_BITS - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(hashes, edges).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        found = np.full(len(wanted), -1, np.int32)
        bucket = (wanted >> self.shift).astype(np.intp)
        at, stop = self.first[bucket], self.first[bucket + 1]
        todo = np.flatnonzero(at < stop)
        for _ in range(self.most):
            if not len(todo):
                break
            here = at[todo]
            hit = self.hashes[here] == wanted[todo]
            found[todo[hit]] = here[hit]
            todo, here = todo[~hit], here[~hit] + 1
            at[todo] = here
            todo = todo[here < stop[todo]]
        return found


@dataclass
class Models:
    """Per order: hashes, log-probability by language; hashes of contexts, log weight of the lower order."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    slope: float = 8.0
    offset: float = 0.0
    limits: np.ndarray | None = None

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Looks texts up; one per task."""

    def __init__(self, models: Models):
        self.models = models
        self.grams = [(SortedHashes(h), p) for h, p in models.grams]
        self.contexts = [(SortedHashes(h), w) for h, w in models.contexts]

    def log_probabilities(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row per position in `at`: log-probability by language of the character there."""
        total = np.zeros((len(at), len(self.models.languages)), np.float32)
        left = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            hashes = gram_hashes(points, order)[at[left]]
            table, values = self.grams[order - 1]
            rows = table.find(hashes)
            hit = rows >= 0
            total[left[hit]] += values[rows[hit]]
            left = left[~hit]
            if not len(left):
                return total
            table, weights = self.contexts[order - 1]
            rows = table.find(gram_hashes(points, order - 1)[at[left] - 1])
            known = rows >= 0
            total[left[known]] += weights[rows[known]]
        total[left] += self.models.unseen
        return total

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character by language (nats) of each text; nan without a letter."""
        points, edges = joined(texts)
        ids = np.repeat(np.arange(len(texts)), np.diff(edges))
        inside = np.arange(len(points)) - edges[ids] >= ORDER - 1
        at = np.flatnonzero(inside)
        values = self.log_probabilities(points, at)
        sizes = np.diff(edges) - (ORDER - 1)
        result = np.full((len(texts), values.shape[1]), np.nan)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(values, starts[some], axis=0, dtype=np.float64)
            result[some] = -sums / sizes[some, None]
        return result

    def predict(self, texts: list[str]) -> dict[str, list]:
        models = self.models
        if not models.languages:
            n = len(texts)
            return {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "entropy": [None] * n, "margin": [None] * n, "rejected": [False] * n}
        every = self.entropies(texts)
        known = ~np.isnan(every[:, 0])
        every[~known] = 0
        best = every.argmin(1)
        ranked = np.sort(every, axis=1)
        low = ranked[:, 0]
        margin = ranked[:, 1] - low if every.shape[1] > 1 else np.ones(len(low))
        score = 1 / (1 + np.exp(-np.clip(models.slope * margin + models.offset, -50, 50)))
        limits = models.limits if models.limits is not None else np.full(every.shape[1], np.inf)
        limits = limits[best] + SHORT_TEXT / np.sqrt(np.array([max(1, len(t)) for t in texts]))
        return {
            "lang_pred": [models.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
            "score": np.where(known, score, 0.0).tolist(),
            "entropy": [float(v) if k else None for v, k in zip(low, known)],
            "margin": [float(v) if k else None for v, k in zip(margin, known)],
            "rejected": (~known | (low > limits)).tolist(),
        }


# --- fitting -------------------------------------------------------------------


def _tables(counts: dict[str, int]) -> list[dict[str, int]]:
    """Counts by order 1 to ORDER: raw for the highest, numbers of distinct left neighbours below."""
    tables = [counts]
    for _ in range(ORDER - 1):
        lower: dict[str, int] = {}
        for gram in tables[0]:
            lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        tables.insert(0, lower)
    return tables


def _context_sums(table: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each context: sum of counts, number of distinct successors."""
    sums: dict[str, tuple[int, int]] = {}
    for gram, count in table.items():
        total, kinds = sums.get(gram[:-1], (0, 0))
        sums[gram[:-1]] = (total + count, kinds + 1)
    return sums


class _Language:
    """Interpolated Kneser-Ney of one language: p(last character | the ones before) of any gram."""

    def __init__(self, counts: dict[str, int], alphabet: int):
        self.tables = _tables(counts)
        self.sums = [_context_sums(t) for t in self.tables]
        self.floor = 1 / (alphabet + 1)
        self.discounts = []
        for table in self.tables:
            ones = sum(c == 1 for c in table.values())
            twos = sum(c == 2 for c in table.values())
            self.discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
        self.memo: dict[str, float] = {"": self.floor}

    def weight(self, context: str) -> float:
        """What the lower order gets after a context; 1 after an unseen one."""
        order = len(context)
        if (found := self.sums[order].get(context)) is None:
            return 1.0
        return self.discounts[order] * found[1] / found[0]

    def probability(self, gram: str) -> float:
        if (known := self.memo.get(gram)) is not None:
            return known
        order = len(gram) - 1
        value = self.weight(gram[:-1]) * self.probability(gram[1:])
        if (count := self.tables[order].get(gram)) is not None:
            value += (count - self.discounts[order]) / self.sums[order][gram[:-1]][0]
        self.memo[gram] = value
        return value


def _hashes_of(grams: list[str]) -> np.ndarray:
    if not grams or not grams[0]:
        return np.zeros(len(grams), np.uint64) + gram_hashes(np.zeros(1, np.uint32), 0)[0]
    order = len(grams[0])
    points = codepoints("".join(grams))
    return gram_hashes(points, order)[order - 1 :: order]


def build(counts: dict[str, dict[str, int]]) -> Models:
    """Models from 4-gram counts by language."""
    names = sorted(counts)
    alphabet = len({c for grams in counts.values() for g in grams for c in g})
    languages = [_Language(counts[n], alphabet) for n in names]
    tables, contexts = [], []
    for order in range(1, ORDER + 1):
        grams = sorted(set().union(*(m.tables[order - 1] for m in languages)))
        values = [[math.log(m.probability(g)) for m in languages] for g in grams]
        tables.append(_sorted_rows(grams, values, len(names)))
        heads = sorted(set().union(*(m.sums[order - 1] for m in languages)))
        weights = [[math.log(m.weight(h)) for m in languages] for h in heads]
        contexts.append(_sorted_rows(heads, weights, len(names)))
    unseen = np.full(len(names), math.log(1 / (alphabet + 1)), np.float32)
    return Models(names, tables, contexts, unseen)


def _sorted_rows(grams: list[str], values: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = _hashes_of(grams)
    order = np.argsort(hashes)
    return hashes[order], np.array(values, np.float32).reshape(len(grams), width)[order]


def _share(seed: int, *more: Column) -> Column:
    """A number in [0, 1) by hash of the id."""
    return F.pmod(F.xxhash64("doc_id", *more, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _cut(chosen: DataFrame) -> DataFrame:
    """(text, lang) of the pieces numbered in `drawn`, neighbours in one."""

    def run(batches):
        for batch in slices(batches):
            texts, langs = [], []
            for text, lang, drawn in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "drawn")]):
                first = 0
                for i in range(1, len(drawn) + 1):
                    if i == len(drawn) or drawn[i] != drawn[i - 1] + 1:
                        texts.append(text[drawn[first] * PIECE : (drawn[i - 1] + 1) * PIECE])
                        langs.append(lang)
                        first = i
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(langs, pa.string())], names=["text", "lang"]
            )

    return chosen.select("text", "lang", "drawn").mapInArrow(run, "text string, lang string")


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table of doc_id, text, lang."""
    schema = "lang string, gram string, n long"

    def run(batches):
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                points, edges = joined([t for t, own in zip(texts, langs == lang) if own])
                ids = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                ends = np.flatnonzero(np.arange(len(points)) - edges[ids] >= ORDER - 1)
                if not len(ends):
                    continue
                windows = np.stack([points[ends - back] for back in range(ORDER - 1, -1, -1)], 1)
                _, first, n = np.unique(gram_hashes(points, ORDER)[ends], return_index=True, return_counts=True)
                rows = windows[first].astype("<u4").tobytes().decode("utf-32-le")
                grams = [rows[i : i + ORDER] for i in range(0, len(rows), ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    found = sample.select("text", "lang").mapInArrow(run, schema)
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def split(docs: DataFrame, sample_chars: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows that may be learned: the sample (text, lang), and the rows outside it (doc_id, text, lang)."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        learned(MODULUS, HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    free = _share(2) >= CALIBRATION_SHARE
    length = F.length("text")
    sums = {"n": F.count("*"), "chars": F.sum(length), "free": F.sum(F.when(free, length))}
    share, may = F.lit(0.0), free
    for r in usable.groupBy("lang").agg(*[v.alias(k) for k, v in sums.items()]).collect():
        own = F.col("lang") == r.lang
        chars = r.chars if r.n < FEW_DOCS else r.free
        share = F.when(own, sample_chars / max(chars or 0, 1)).otherwise(share)
        if r.n < FEW_DOCS:
            may = may | own
    last = F.greatest(F.ceil(length / PIECE).cast("int") - 1, F.lit(0))
    ruled = usable.withColumns({"share": F.when(may, share).otherwise(0.0), "last": last})
    numbers = F.filter(F.sequence(F.lit(0), "last"), lambda k: _share(1, k) < F.col("share"))
    drawn = ruled.withColumn("drawn", numbers)
    inside = F.size("drawn") > 0
    return _cut(drawn.where(inside)), drawn.where(~inside).select("doc_id", "text", "lang")


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models of the languages of `docs`, learned from a bounded sample of the rows that may be learned."""
    sample, others = split(docs, sample_chars)
    table = count_grams(sample).toPandas()
    counts = {
        lang: dict(zip(part["gram"], part["n"].astype(int))) for lang, part in table.groupby("lang")
    }
    models = build(counts)
    if not models.languages:
        return models
    # a learned language without a model has no letter in its sampled pieces
    checked = predict(others, models, keep=("lang",)).select("lang", "lang_pred", "entropy", "margin")
    folder = f"{shared_folder(docs.sparkSession)}/checked"
    checked.where("entropy is not null").write.parquet(folder)
    return calibrate(models, docs.sparkSession.read.schema(checked.schema).parquet(folder))


def calibrate(models: Models, seen: DataFrame) -> Models:
    """Logistic score of the margin; per language, a limit far above the entropies of its own rows."""
    found = seen.rollup("lang_pred").agg(
        F.count("*").alias("n"),
        F.stddev_pop("entropy").alias("deviation"),
        F.percentile_approx("entropy", 0.995, 10_000).alias("high"),
    )
    limits = {r.lang_pred: r.high + 3 * r.deviation + 1.0 for r in found.collect() if r.n >= FEW_CHECKED}
    pooled = limits.get(None, -float(models.unseen[0]))
    models.limits = np.array([limits.get(lang, pooled) for lang in models.languages])
    steps = seen.select(
        F.round(F.least("margin", F.lit(5.0)), 3).alias("margin"),
        (F.col("lang") == F.col("lang_pred")).cast("double").alias("right"),
    )
    bins = steps.groupBy("margin", "right").count().orderBy("margin", "right").toPandas()
    n = bins["count"].to_numpy(float)
    if n.sum() < FEW_CHECKED:
        return models
    x = np.stack([bins["margin"].to_numpy(float), np.ones(len(bins))], 1)
    target = (bins["right"].to_numpy(float) * n.sum() + 0.5) / (n.sum() + 1)  # keeps the fit finite
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, x.T @ (n * (target - p)) - 1e-3 * w)
    models.slope, models.offset = max(float(w[0]), 0.0), float(w[1])
    return models


def predict(docs: DataFrame, models: Models, keep=("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred, score, entropy, margin, rejected of every row."""

    def start() -> Callable:
        scorer = models.open()
        return lambda texts, part: scorer.predict(texts)

    new = "lang_pred string, score double, entropy double, margin double, rejected boolean"
    return map_texts(docs, new, start, keep)


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The rows that are not rejected, with their columns as they are."""

    def start() -> Callable:
        scorer = models.open()
        return lambda texts: ~np.array(scorer.predict(texts)["rejected"], bool)

    bound_batches(docs.sparkSession)
    return docs.where(over_texts(F.col("text"), "boolean", start))
