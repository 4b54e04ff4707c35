"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Texts are split without regular expressions. Code points are mapped to classes by an array; a small
automaton over the classes tells where a match starts. Its transition functions form a finite monoid,
so the states at all positions come from an associative scan: along columns of a matrix of
codepoints, over the rows' totals by doubling, then back. The slices between match starts are merged
by rank, each distinct one once as long as the memo holds it.

Null and empty texts have no ids and decode to no bytes. Rows are independent. Texts of any length
are encoded whole; a long slice is merged with a heap.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import Cache, map_texts

RANKS = "byte_bpe_50k.tiktoken"
CACHED_SLICES = 150_000  # a generation of the memo, each task holds two
LONG_SLICE = 48  # bytes from which the heap form merges

# Classes of a codepoint.
LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: what the automaton reads. A white space is "last" if a non-space follows in its document.
S_LETTER, S_NUMBER, S_OTHER, S_LAST_BLANK, S_LAST_WHITE, S_WHITE, S_SHORT, S_LONG, S_EDGE = range(9)
# States: what the symbol just read belongs to.
AT_EDGE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK, IN_WHITE, WHITE, ONE_MORE, TWO_MORE, CLOSED = range(10)


def _next(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a match starts at it."""
    if symbol == S_EDGE:
        return AT_EDGE, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return CLOSED, False
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    if symbol in (S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG):
        if state == BLANK or state == run:
            return run, False
        if symbol == S_SHORT:
            return ONE_MORE, True
        if symbol == S_LONG:
            return TWO_MORE, True
        return run, True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return (BLANK if symbol == S_LAST_BLANK else WHITE), True


class Automaton:
    """The monoid of transition functions: numbers of functions, and a table of their products."""

    def __init__(self, states: int = 10, symbols: int = 9):
        moves = [[_next(s, x) for s in range(states)] for x in range(symbols)]
        single = [tuple(to for to, _ in row) for row in moves]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(states)), *single]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in single:
                if (fg := tuple(g[s] for s in f)) not in known:
                    known[fg] = len(known)
                    todo.append(fg)
        functions = np.array(list(known), np.int64)  # by number; number 0 is the identity
        self.size = len(functions)
        self.of_symbol = np.array([known[f] for f in single], np.uint16)
        products = np.empty((self.size, self.size), np.uint16)
        for i, f in enumerate(functions):
            products[i] = [known[tuple(row)] for row in functions[:, f]]
        self.product = products.ravel()  # [f * size + g]: first f, then g
        self.apply = functions.astype(np.uint8)
        self.starts = np.array([[m for _, m in row] for row in moves]).T.copy()  # [state, symbol]

    def match_starts(self, symbols: np.ndarray, columns: int = 128) -> np.ndarray:
        """For each symbol, whether a match starts there."""
        n = len(symbols)
        rows = -(-n // columns)
        grid = np.full(rows * columns, S_EDGE, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, columns).T)
        prefix = np.empty((columns, rows), np.uint16)
        prefix[0] = self.of_symbol[grid[0]]
        for j in range(1, columns):
            prefix[j] = self._then(prefix[j - 1], self.of_symbol[grid[j]])
        total, step = prefix[-1].copy(), 1
        while step < rows:  # after it, total[r] is the product of rows 0..r
            total[step:] = self._then(total[:-step].copy(), total[step:])
            step *= 2
        entry = np.full(rows, AT_EDGE, np.uint8)
        entry[1:] = self.apply[total[:-1], AT_EDGE]
        before = np.empty((columns, rows), np.uint8)
        before[0] = entry
        before[1:] = self.apply[prefix[:-1], entry]
        return self.starts[before, grid].T.ravel()[:n]

    def _then(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self.product[f.astype(np.intp) * self.size + g]


def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, by the tables of the tokenizer library itself."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    classes = np.full(0x110000, OTHER, np.uint8)
    for which, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        kind = tiktoken.Encoding(
            "classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}
        )
        members = bytes(kind.encode_ordinary(every)).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = which
    return classes


def runs_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length form, small enough to ship with a task."""
    first = np.flatnonzero(np.diff(classes, prepend=255))
    return first, classes[first]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a slice: join the pair of lowest rank, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) >= LONG_SLICE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same in n log n steps: pairs in a heap, parts in a linked list by their first byte."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue  # one of its parts has grown since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Codec:
    """Encodes and decodes texts; one per task."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray], cached: int = CACHED_SLICES):
        first, kinds = runs
        self.classes = np.repeat(kinds, np.diff(np.append(first, 0x110000)))
        self.ranks, self.cache, self.automaton = load_ranks(path), Cache(cached), Automaton()
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _symbols(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Symbols of codepoints; `edges` are the positions between documents."""
        kinds = self.classes[points]
        symbols = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE], np.uint8)[kinds]
        solid = kinds != SPACE
        solid[edges] = False
        last = np.append(solid[1:], False) & (kinds == SPACE)
        symbols[last] = S_LAST_WHITE
        symbols[last & (points == 0x20)] = S_LAST_BLANK
        marks = np.flatnonzero(points == 0x27)
        marks = marks[np.isin(marks, edges, invert=True)] if len(marks) else marks
        ahead = lambda k: points[np.minimum(marks + k, len(points) - 1)]  # noqa: E731  no document ends in between: edges are 0
        one, two = ahead(1), ahead(2)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
        long |= (one == ord("l")) & (two == ord("l"))
        symbols[marks[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        symbols[marks[long]] = S_LONG
        symbols[edges] = S_EDGE
        return symbols

    def slices(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Matches of all texts in order, and how many each text has."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = self.automaton.match_starts(self._symbols(points, edges))
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(widths) - widths  # byte of each codepoint
        begin = np.flatnonzero(starts)
        cuts, data = at[begin].tolist(), joined.encode()
        pieces = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        at_edge = np.isin(begin, edges)
        counts = np.diff(np.append(-1, np.flatnonzero(at_edge))) - 1
        return [p for p, edge in zip(pieces, at_edge.tolist()) if not edge], counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        pieces, counts = self.slices(texts)
        known = {p: self.cache.get(p) for p in set(pieces)}
        for piece, ids in known.items():
            if ids is None:
                known[piece] = ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
                self.cache.put(piece, ids)
        find, stop = known.__getitem__, np.cumsum(counts).tolist()
        return [
            np.frombuffer(b"".join(map(find, pieces[a:b])), "<u4") for a, b in zip([0, *stop], stop)
        ]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's bytes start, and at the end the number of bytes."""
        return np.append(0, np.cumsum(self.lengths[ids]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the ids, each put at its offset."""
        shift = np.repeat(self.firsts[ids] - offsets[:-1], np.diff(offsets))
        return self.bytes[np.arange(offsets[-1]) + shift].tobytes()


@cache
def _codec(path: str, first: bytes, kinds: bytes) -> Codec:
    """One per Python worker, kept from task to task."""
    return Codec(path, (np.frombuffer(first, np.int64), np.frombuffer(kinds, np.uint8)))


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, `ids` and `offsets` (little-endian unsigned 32- and 64-bit integers), and `decoded`,
    the bytes that the ids stand for."""
    path, runs = ranks or public_tokenizers.path(RANKS), runs_of(codepoint_classes())

    def start() -> Callable:
        codec = _codec(path, *(a.tobytes() for a in runs))

        def step(texts, part):
            every = codec.encode(texts)
            offsets = [codec.offsets(ids) for ids in every]
            return {
                "ids": [ids.tobytes() for ids in every],
                "offsets": [o.astype("<u8").tobytes() for o in offsets],
                "decoded": [codec.decode(i, o) for i, o in zip(every, offsets)],
            }

        return step

    return map_texts(docs, "ids binary, offsets binary, decoded binary", start)


def report(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
