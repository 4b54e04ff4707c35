"""LM scoring by masked pseudo-likelihood.

Every word of the corpus has a probability given the words on both sides of it; a document's score is
the sum of the log-probabilities of its words. The softmax has two levels: a window network, which does
not read the word itself, gives the word's token a probability, and the token's probability is
multiplied by the word's share of all words of the token, from counts over the whole corpus. The
network: an embedding per offset in the window and token, summed, tanh, a softmax layer. It is trained
in numpy.

Tokens: the most frequent words of the corpus, each with a token of its own (share 1), then buckets by
word ending for the rest, and one token for what lies beyond a text's ends. The words grow with the
corpus: their counts stay a table, joined to the words of each piece. A word that the corpus does not
have counts as one seen once. Words are what lies between ASCII blanks, in lower case.

Texts are shuffled once, by a hash of the row, into pieces that hold each word once and the texts as
numbers of these words; a text lies whole in one piece. All later passes read the pieces.

Training covers every token of all documents: each partition takes steps on its own pieces from the same start,
and the weights are averaged by tokens seen; this is one round, `rounds` of them are made. The averaging is a
grouped sum over the cells of the weights.

Null and empty texts, and texts without words, have no tokens: sum 0, mean null. Repeated rows count
again. Texts are read whole. Without any word in the corpus the start weights are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sessora.llm.common import map_texts, shared_folder, slices, texts_of

WORDS = 95
BUCKETS = 32
EDGE = WORDS + BUCKETS  # the token beyond both ends
TOKENS = EDGE + 1
WINDOW = 2  # words on each side
OFFSETS = (*range(-WINDOW, 0), *range(1, WINDOW + 1))
WIDTH = 16
BATCH = 8192  # tokens a step
RATE = 5.0
ROUNDS = 1
SEED = 5
PIECE_CHARS = 8_000_000  # a piece, expected
PIECE_TOKENS = 2_000_000  # from which a piece takes no further text
PIECE = "piece long, docs array<long>, sizes binary, ids binary, words array<string>, counts array<long>"


@dataclass
class Network:
    words: list[str]
    inputs: np.ndarray  # offset, token, width
    outputs: np.ndarray  # width, token
    bias: np.ndarray
    totals: np.ndarray = field(default_factory=lambda: np.zeros(TOKENS))  # words of the corpus by token

    @classmethod
    def start(cls, words: list[str], shares: np.ndarray) -> Network:
        """Small random weights; the bias gives the tokens' own shares."""
        rng = np.random.RandomState(SEED)
        draw = lambda *size: rng.normal(0, 0.3, size).astype(np.float32)
        bias = np.log(shares + 1e-6).astype(np.float32)
        return cls(words, draw(len(OFFSETS), TOKENS, WIDTH), draw(WIDTH, TOKENS), bias)

    def copy(self) -> Network:
        return Network(self.words, self.inputs.copy(), self.outputs.copy(), self.bias.copy(), self.totals)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inputs.ravel(), self.outputs.ravel(), self.bias])

    def filled(self, flat: np.ndarray) -> Network:
        a, b = self.inputs.size, self.inputs.size + self.outputs.size
        part = [flat[:a].reshape(self.inputs.shape), flat[a:b].reshape(self.outputs.shape), flat[b:]]
        return Network(self.words, *[p.astype(np.float32) for p in part], self.totals)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Of rows of neighbours, a column per offset."""
        total = self.inputs[0][context[:, 0]]
        for k in range(1, len(OFFSETS)):
            total += self.inputs[k][context[:, k]]
        return np.tanh(total)

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        scores = hidden @ self.outputs
        scores += self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def log_likelihoods(self, tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p(token | neighbours) of each row."""
        found = np.empty(len(tokens))
        for at in range(0, len(tokens), BATCH):
            part = slice(at, at + BATCH)
            p = self.probabilities(self.hidden(context[part]))
            found[part] = np.log(p[np.arange(len(p)), tokens[part]] + 1e-30)
        return found

    def step(self, tokens: np.ndarray, context: np.ndarray, rate: float) -> None:
        """One gradient step on the mean log-likelihood of the rows."""
        hidden = self.hidden(context)
        error = self.probabilities(hidden)
        error[np.arange(len(tokens)), tokens] -= 1
        error *= rate / len(tokens)
        back = (error @ self.outputs.T) * (1 - hidden * hidden)
        self.outputs -= hidden.T @ error
        self.bias -= error.sum(0)
        for k in range(len(OFFSETS)):
            order = np.argsort(context[:, k], kind="stable")
            ids = context[order, k]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            self.inputs[k][ids[first]] -= np.add.reduceat(back[order], first, axis=0)


class Tokens:
    """Token numbers of words; one per task."""

    def __init__(self, words: list[str]):
        self.known = {w.encode(): i for i, w in enumerate(words)}

    def of(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        known = {w: self._one(w) for w in set(words)}
        return np.fromiter(map(known.__getitem__, words), np.int16, len(words))

    def _one(self, word: bytes) -> int:
        if (found := self.known.get(word)) is not None:
            return found
        return WORDS + zlib.crc32(word[-3:]) % BUCKETS

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts, their neighbours, and the number of tokens of each text."""
        return lined([self.of(t) for t in texts])

    def of_words(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self._one(w.encode()) for w in words), np.int16, len(words))


def lined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all parts, their neighbours in the same part, and the number of tokens of each."""
    gap = np.full(WINDOW, EDGE, np.int16)
    sizes = np.array([len(p) for p in parts])
    line = np.concatenate([x for p in parts for x in (gap, p)] + [gap])
    at = np.arange(sizes.sum()) + np.repeat(WINDOW * np.arange(1, len(parts) + 1), sizes)
    context = np.stack([line[at + k] for k in OFFSETS], axis=1)
    return line[at], context, sizes


class _Piece:
    """Texts as numbers of the piece's own words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.docs, self.sizes, self.ids, self.n = [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        words, known = text.lower().encode().split(), self.known
        self.ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.sizes.append(len(words))
        self.n += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        one = lambda values, kind: pa.array([values], kind)
        return pa.RecordBatch.from_arrays(
            [
                one(number, pa.int64()),
                one(self.docs, pa.list_(pa.int64())),
                one(np.array(self.sizes, np.int64).tobytes(), pa.binary()),
                one(ids.tobytes(), pa.binary()),
                one([w.decode() for w in self.known], pa.list_(pa.string())),
                one(np.bincount(ids, minlength=len(self.known)).tolist(), pa.list_(pa.int64())),
            ],
            names=["piece", "docs", "sizes", "ids", "words", "counts"],
        )


def pieces(docs: DataFrame) -> DataFrame:
    """PIECE rows of all texts, written once to the shared folder.

    Which rows share a piece follows from ids, texts and the corpus size, not from files or partitions.
    """
    texts = texts_of(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // PIECE_CHARS))
    key = F.xxhash64("doc_id", "text")
    dealt = texts.withColumns({"chunk": F.pmod(key, F.lit(n)), "at": key})
    dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", "at", "doc_id")

    def run(batches):
        chunk, k, piece = None, 0, _Piece()
        for part in slices(batches):
            columns = part.column("chunk"), part.column("doc_id"), part.column("text").fill_null("")
            for own, doc_id, text in zip(*[c.to_pylist() for c in columns]):
                if piece.docs and (own != chunk or piece.n >= PIECE_TOKENS):
                    yield piece.row((chunk << 24) + k)
                    piece, k = _Piece(), k + 1
                if own != chunk:
                    chunk, k = own, 0
                piece.add(doc_id, text)
        if piece.docs:
            yield piece.row((chunk << 24) + k)

    folder = f"{shared_folder(docs.sparkSession)}/pieces"
    dealt.select("chunk", "doc_id", "text").mapInArrow(run, PIECE).write.parquet(folder)
    return docs.sparkSession.read.schema(PIECE).parquet(folder)


def word_counts(parts: DataFrame) -> DataFrame:
    """(word, n) of the whole corpus, written once to the shared folder."""
    one = parts.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    found = one.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    folder = f"{shared_folder(parts.sparkSession)}/words"
    found.write.parquet(folder)
    return parts.sparkSession.read.schema("word string, n long").parquet(folder)


def _bucket(word: str) -> Column:
    """Tokens._one of a word that has no token of its own."""
    octets = F.col(word).cast("binary")
    end = F.when(F.length(octets) > 3, F.substring(octets, -3, 3)).otherwise(octets)
    return (WORDS + F.crc32(end) % BUCKETS).cast("int")


def _token(words: list[str], word: str = "word") -> Column:
    """Tokens._one of a word."""
    place = F.array_position(F.array(*[F.lit(w) for w in words]).cast("array<string>"), F.col(word))
    return F.when(place > 0, (place - 1).cast("int")).otherwise(_bucket(word))


def vocabulary(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words, and how many words of the corpus each token stands for."""
    best = counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()
    words, totals = [r.word for r in best], np.zeros(TOKENS)
    totals[: len(best)] = [r.n for r in best]
    rest = counts.where(~F.col("word").isin(words)) if words else counts
    for r in rest.groupBy(_bucket("word").alias("token")).agg(F.sum("n").alias("n")).collect():
        totals[r.token] = r.n
    return words, totals


def _tokens(row: dict, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a PIECE row: tokens of its words, numbers of its words in a line, tokens of each text."""
    own, ids = tokens.of_words(row["words"]), np.frombuffer(row["ids"], np.int32)
    return own, ids, np.split(own[ids], np.cumsum(np.frombuffer(row["sizes"], np.int64))[:-1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _round(parts: DataFrame, network: Network, rate: float) -> Network:
    """Weights averaged over partitions, each trained on its own pieces from `network`."""

    def run(batches):
        own, tokens, seen = network.copy(), Tokens(network.words), 0
        for row in _rows(batches):
            target, context, _ = lined(_tokens(row, tokens)[2])
            for at in range(0, len(target), BATCH):
                own.step(target[at : at + BATCH], context[at : at + BATCH], rate)
            seen += len(target)
        if seen:
            values = own.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), seen))],
                names=["cell", "value", "seen"],
            )

    cells = parts.select("sizes", "ids", "words").mapInArrow(run, "cell long, value double, seen long")
    total = cells.groupBy("cell").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas()
    if not len(total):
        return network
    flat = np.zeros(len(total))
    flat[total["cell"]] = total["value"]
    return network.filled(flat)


def _fit(parts: DataFrame, counts: DataFrame, rounds: int) -> Network:
    words, totals = vocabulary(counts)
    network = Network.start(words, totals / max(totals.sum(), 1))
    network.totals = totals
    for k in range(rounds):
        network = _round(parts, network, RATE / (k + 1))
    return network


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    parts = pieces(docs)
    return _fit(parts, word_counts(parts), rounds)


def score(docs: DataFrame, network: Network, keep=("doc_id",)) -> DataFrame:
    """The network's part: columns `keep`, n_tokens, log_likelihood (the sum) of the tokens, and its mean."""

    def start() -> Callable:
        tokens = Tokens(network.words)

        def step(texts, part):
            target, context, sizes = tokens.rows(texts)
            edges = np.append(0, np.cumsum(network.log_likelihoods(target, context)))
            stop = np.cumsum(sizes)
            sums = edges[stop] - edges[stop - sizes]
            return {
                "n_tokens": sizes,
                "log_likelihood": sums,
                "mean_log_likelihood": [s / n if n else None for s, n in zip(sums, sizes.tolist())],
            }

        return step

    new = "n_tokens long, log_likelihood double, mean_log_likelihood double"
    return map_texts(docs, new, start, keep)


def _score_words(parts: DataFrame, counts: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) of the words, mean_log_likelihood of every row."""
    schema = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
    asked = parts.select(F.col("piece").alias("of"), F.posexplode("words").alias("at", "word"))
    known = asked.join(counts, "word", "left").select(
        "of", "at", F.coalesce("n", F.lit(1)).alias("n"), _token(network.words).alias("token")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, n, token = (right.column(c).to_numpy() for c in ("at", "n", "token"))
        own, shares = np.zeros(len(at), np.int16), np.zeros(len(at))
        own[at] = token
        shares[at] = np.where(token >= WORDS, np.log(n / np.maximum(network.totals[token], n)), 0.0)
        ids, lengths = (np.frombuffer(left.column(c)[0].as_buffer(), d) for c, d in (("ids", np.int32), ("sizes", np.int64)))
        target, context, sizes = lined(np.split(own[ids], np.cumsum(lengths)[:-1]))
        edges = np.append(0, np.cumsum(network.log_likelihoods(target, context) + shares[ids]))
        stop = np.cumsum(sizes)
        sums = edges[stop] - edges[stop - sizes]
        means = [s / n if n else None for s, n in zip(sums, sizes.tolist())]
        columns = [left.column("docs")[0].values, pa.array(sizes), pa.array(sums), pa.array(means, pa.float64())]
        return pa.table(columns, names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    own = parts.select("piece", "docs", "sizes", "ids")
    return own.groupBy("piece").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def score_words(docs: DataFrame, counts: DataFrame, network: Network) -> DataFrame:
    """Scores of texts that need not be the corpus that gave `counts` and `network`."""
    return _score_words(pieces(docs), counts, network)


def score_corpus(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every row scored by what its own corpus gives."""
    parts = pieces(docs)
    counts = word_counts(parts)
    return _score_words(parts, counts, _fit(parts, counts, rounds))
