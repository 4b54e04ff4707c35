"""Packing by power-of-two decomposition.

Each document's ids, with an end id appended, are cut into pieces whose lengths are powers of two, the
longest first: as many of `max_tokens` as fit, then the binary digits of the rest. Pieces of equal
length form a bucket; every piece is a sequence of its own, so that no sequence crosses documents and
none needs padding. Null and empty texts have the end id alone, one piece of one id. Repeated rows are
packed once each. Cutting is by whole documents of any length; no id is dropped.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import map_texts

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 4096
CACHED_WORDS = 750_000  # of the memo that a Python worker keeps

_LETTERS = bytes(i for i in range(256) if chr(i).isalpha())
_SIMPLE = _LETTERS + b"0123456789 \n.,"
_MARK_PAIRS = ("..", ".,", ",.", ",,")


def cuts(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n ids, longest first. max_tokens is a power of two."""
    whole, rest = divmod(n, max_tokens)
    digits = [1 << k for k in range(max_tokens.bit_length() - 2, -1, -1) if rest >> k & 1]
    return [max_tokens] * whole + digits


class WordEncoder:
    """Ids of texts by a tokenizer that never joins over a space or a line end, word by word."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.cached = Tokenizer.from_file(path), {"": b""}, cached

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [self._plain(t).replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.cache.get, row)) for row in words]
        if missing := {w for ws, ids in zip(words, found) if None in ids for w, i in zip(ws, ids) if i is None}:
            new = self._encode(missing)
            for ws, ids in zip(words, found):
                if None in ids:
                    ids[:] = [new[w] if i is None else i for w, i in zip(ws, ids)]
            if len(self.cache) + len(new) > self.cached:
                self.cache = {"": b""}
            self.cache.update(new)
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]

    def _encode(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words, and of the words without their last mark."""
        cut = {w: self._core(w) for w in missing}
        parts = sorted({p for core in cut.values() for p in core if p})
        known = {p: ids for p in parts if (ids := self.cache.get(p)) is not None}
        known |= self._encode_letters([p for p in parts if p not in known and p.isalpha()])
        rest = [p for p in parts if p not in known]
        for part, encoded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[part] = np.array(encoded.ids, "<u4").tobytes()
        return known | {w: b"".join(known[p] for p in core if p) for w, core in cut.items()}

    def _encode_letters(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone, which the tokenizer keeps apart at blanks, in one call."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, place = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids, np.int64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        if len(starts) != len(words):
            return {}  # a letter to one library is none to the other
        stops = [*starts[1:].tolist(), len(ids)]
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, starts.tolist(), stops)}

    @staticmethod
    def _core(word: str) -> tuple[str, str]:
        """A word without its last mark, and the mark: the tokenizer always cuts between the two."""
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha():
            return word[:-1], word[-1]
        return word, ""

    @staticmethod
    def _plain(text: str) -> str:
        """The text in a form that has fewer distinct words, where the ids are certain to be the same:
        in lower case, as the tokenizer makes it itself, and with blanks before marks, where it cuts."""
        if "<|" in text:
            return text  # special tokens are matched as written
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        text = text.lower()
        if data.translate(None, _SIMPLE) or any(pair in text for pair in _MARK_PAIRS):
            return text  # a mark after a mark belongs to it
        return text.replace("\n", " ").replace(", ", " , ").replace(". ", " . ")


@functools.cache
def _encoder(path: str, cached: int) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    return WordEncoder(path, cached)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    cached: int = CACHED_WORDS,
) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, bucket (log2 of length), ids as
    little-endian unsigned 32-bit integers, sequence_id, offset. A Python worker remembers `cached` words.

    sequence_id is the task's number in its upper bits and a counter below, so it stays unique when a
    lost task runs again.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def start() -> Callable:
        encode = _encoder(path, cached)

        def step(texts, part):
            rows = []
            for ids in encode(texts):
                every = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, pieces = 0, []
                for n in cuts(len(every), max_tokens):
                    piece = every[at : at + n]
                    pieces.append(
                        {"start": at, "length": n, "bucket": n.bit_length() - 1, "ids": piece.tobytes()}
                    )
                    at += n
                rows.append(pieces)
            return {"pieces": rows, "doc_tokens": [sum(p["length"] for p in r) for r in rows]}

        return step

    piece = "array<struct<start long, length long, bucket int, ids binary>>"
    found = map_texts(docs, f"pieces {piece}, doc_tokens long", start)
    pieces = found.select("doc_id", "doc_tokens", F.explode("pieces").alias("p"))
    return pieces.select(
        "doc_id",
        "p.start",
        "p.length",
        "doc_tokens",
        "p.bucket",
        "p.ids",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def report(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        *["doc_id", "start", "length"],
        F.crc32("ids").alias("ids_crc32"),
        *["doc_tokens", "sequence_id", "offset", "bucket"],
    )
