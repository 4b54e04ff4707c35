"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories.

The categories are, in order, the parts of a toxic label that common words of abuse tell apart
(`insult`, `contempt`), then `toxic` itself as labelled. A model is a logistic regression on how often
chosen words and beginnings of words occur and on the probabilities of the categories before it. In training those come from
models of other folds, so that a later model sees what it will see on new rows.

Labels come from a bounded sample: the SAMPLE_ROWS labelled rows whose ids hash lowest. Words are
chosen by their association with the label over that sample, WORDS at most. Every text is scored,
whole. Null and empty texts have no words and get the model's constant. Rows are independent. Null
labels and ids are not learned from; a repeated label row counts again. Without both classes the
probability is the share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import map_texts, stored, texts_of

SAMPLE_ROWS = 20_000
WORDS = 400
BEGINNINGS = (6, 8)  # letters
LEAST_DOCS = 5
FOLDS = 4
PENALTY = 1.0
SEED = 11

# Words by which a toxic text is told to be of a category.
TERMS = {
    "insult": "idiot moron stupid dumb fool clown loser imbecile jerk liar".split(),
    "contempt": "trash scum worthless pathetic disgusting filth vermin garbage vile useless".split(),
}
CATEGORIES = (*TERMS, "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(text: str) -> list[str]:
    """The words, and the beginnings of longer ones with a star."""
    words = words_of(text)
    return words + [w[:k] + "*" for k in BEGINNINGS for w in words if len(w) > k]


@dataclass
class Chain:
    words: list[str]
    weights: list[np.ndarray]  # by category: words, earlier probabilities, constant

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        """Column per category, computed one after the other."""
        found = np.zeros((len(features), 0))
        for w in self.weights:
            p = _logistic(_with_constant(features, found) @ w)
            found = np.concatenate([found, p[:, None]], axis=1)
        return found

    def vectorizer(self) -> Callable[[list[str]], np.ndarray]:
        place = {w: i for i, w in enumerate(self.words)}

        def vectors(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), len(place)))
            for row, text in enumerate(texts):
                for word in terms_of(text):
                    if (i := place.get(word)) is not None:
                        counts[row, i] += 1
            return np.log1p(counts)

        return vectors


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _with_constant(features: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.concatenate([features, earlier, np.ones((len(features), 1))], axis=1)


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = PENALTY, steps: int = 15) -> np.ndarray:
    """Logistic regression by Newton steps on rows that stand for `n` each; the last column is a
    constant, free of penalty."""
    share = np.clip((y * n).sum() / n.sum(), 1e-6, 1 - 1e-6)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _logistic(x @ w)
        curve = n * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def train_chain(features: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights by category; labels has a column for each, folds a number for each row.

    Equal rows, most often those without any chosen word, are computed once and counted.
    """
    whole = np.concatenate([features, labels, folds[:, None]], axis=1)
    places: dict[bytes, int] = {}
    counts: list[int] = []
    first = []
    for i, row in enumerate(whole):
        if (at := places.setdefault(row.tobytes(), len(first))) == len(first):
            first.append(i)
            counts.append(0)
        counts[at] += 1
    features, labels, folds, n = features[first], labels[first], folds[first], np.array(counts, float)
    earlier = np.zeros((len(features), 0))
    weights = []
    for y in labels.T:
        x = _with_constant(features, earlier)
        weights.append(train(x, y, n))
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            out = folds == k
            if out.any() and not out.all():
                unseen[out] = _logistic(x[out] @ train(x[~out], y[~out], n[~out]))
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return weights


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of the labelled rows with the lowest hashes, stored. Broadcast: `rows` at most.

    Of documents that repeat an id the least text counts, so that there are `rows` at most.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()
    )
    chosen = wanted.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "toxic").limit(rows)
    labelled = texts_of(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = labelled.groupBy("doc_id").agg(F.min("text").alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id"))


def _counted(sample: DataFrame) -> DataFrame:
    """(word, n, bad): documents of the sample with the word, and toxic ones among them."""

    def start() -> Callable:
        return lambda texts, part: {"words": [sorted(set(terms_of(t))) for t in texts]}

    found = map_texts(sample, "words array<string>", start, keep=("toxic",))
    return (
        found.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: int = WORDS) -> Chain:
    sample = _sample(docs, labels, rows)
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not total.n or total.bad in (0, total.n):
        share = np.clip(total.bad / total.n if total.n else 0.0, 1e-6, 1 - 1e-6)
        constant = np.log(share / (1 - share))
        return Chain([], [np.append(np.zeros(k), constant) for k in range(len(CATEGORIES))])
    # chi-square of the word's presence against the label
    n, bad, all_n, all_bad = F.col("n"), F.col("bad"), float(total.n), float(total.bad)
    excess = bad - n * (all_bad / all_n)
    strength = excess * excess / (n * (1 - n / all_n) + 1e-9)
    best = (
        _counted(sample)
        .where(n >= LEAST_DOCS)
        .orderBy(strength.desc(), "word")
        .limit(words)
        .select("word")
    )
    chain = Chain(sorted(r.word for r in best.collect()), [])
    rows_of = _training_rows(sample, chain)
    weights = train_chain(*rows_of)
    return Chain(chain.words, weights)


def _training_rows(sample: DataFrame, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels by category, folds; the sample's bound holds for what the driver gets."""

    def start() -> Callable:
        vectors = chain.vectorizer()

        def step(texts, part):
            counts = vectors(texts)
            toxic = part.column("toxic").to_pylist()
            own = [set(words_of(t)) for t in texts]
            kinds = [[int(bool(bad and w & set(TERMS[k]))) for k in TERMS] for bad, w in zip(toxic, own)]
            return {
                "place": [np.flatnonzero(c).tolist() for c in counts],
                "value": [c[c > 0].tolist() for c in counts],
                "kinds": [[*k, t] for k, t in zip(kinds, toxic)],
            }

        return step

    new = "place array<int>, value array<double>, kinds array<int>"
    table: pd.DataFrame = map_texts(sample, new, start, keep=("doc_id", "toxic")).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    features = np.zeros((len(table), len(chain.words)))
    for row, (place, value) in enumerate(zip(table["place"], table["value"])):
        features[row, np.asarray(place, int)] = value
    labels = np.array(table["kinds"].tolist(), float)
    return features, labels, table["doc_id"].to_numpy() % FOLDS


def score(docs: DataFrame, chain: Chain, keep=("doc_id",)) -> DataFrame:
    """Columns `keep`, predicted (1 from a score of 0.5), score (of the last category), and a
    probability for each earlier category."""
    names = [f"p_{c}" for c in CATEGORIES[:-1]]

    def start() -> Callable:
        vectors = chain.vectorizer()

        def step(texts, part):
            found = chain.probabilities(vectors(texts))
            last = found[:, -1]
            earlier = {name: found[:, i] for i, name in enumerate(names)}
            return {"predicted": (last >= 0.5).astype(np.int32), "score": last} | earlier

        return step

    new = "predicted int, score double" + "".join(f", {n} double" for n in names)
    return map_texts(docs, new, start, keep)
