"""Word shingles of a text as hashes, and their SuperMinHash signatures.

Words are runs of characters other than the six ASCII white spaces, A-Z in lower case. A set holds each
run of `width` words once; a text of fewer words has one shingle, all its words; a text without words
has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from sessora.llm.common import splitmix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROUND_BITS = 48
EMPTY_SLOT = np.uint64(np.iinfo(np.uint64).max)
SMALL_SET = 256


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    rows = [t.encode().lower().split() for t in texts]
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set().union(*rows)} if rows else {}
    return [_shingles(np.fromiter(map(known.__getitem__, r), np.uint64, len(r)), width) for r in rows]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = splitmix(total * _BASE + words[i : i + count])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row per set. Small sets go together, since each round costs the same for one as for many."""
    found = np.empty((len(sets), size), np.uint64)
    small = [i for i, s in enumerate(sets) if len(s) < SMALL_SET]
    for i, elements in enumerate(sets):
        if len(elements) >= SMALL_SET:
            found[i] = super_minhash([elements], size)[0]
    while small:
        some, small = small[:64], small[64:]
        found[some] = super_minhash([sets[i] for i in some], size)
    return found


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures: slot s holds the least (rank, random value) of an element that its own
    random permutation sends to s.

    In round j each element gives a value of rank j to the slot that its permutation has at j, by a
    Fisher-Yates step. Ranks only grow, so a set is done once all its slots have a value.
    """
    result = np.full(len(sets) * size, EMPTY_SLOT, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seeds = splitmix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    order = None  # of slots, by element; written down from the second round on
    for j in range(size):
        seeds = splitmix(seeds)
        pick = j + ((seeds >> np.uint64(32)) % np.uint64(size - j)).astype(np.intp)
        slots, rows = pick, np.arange(len(owner))
        if order is not None:
            slots = order[rows, pick].astype(np.intp)
        value = np.uint64(j << _ROUND_BITS) | (splitmix(seeds ^ _BASE) >> np.uint64(64 - _ROUND_BITS))
        np.minimum.at(result, owner * size + slots, value)
        left = (result.reshape(-1, size) == EMPTY_SLOT).any(1)[owner]
        if not left.any():
            break
        if order is None:
            order = np.empty((len(owner), size), np.uint16)
            order[:] = np.arange(size)
        _swap(order, rows, j, pick)
        if not left.all():
            owner, seeds, order = owner[left], seeds[left], order[left]
    return result.reshape(-1, size)


def _swap(order: np.ndarray, rows: np.ndarray, j: int, pick: np.ndarray) -> None:
    there = order[rows, pick]
    order[rows, pick] = order[:, j]
    order[:, j] = there


def bands(found: np.ndarray, count: int, rows: int) -> np.ndarray:
    """For each signature a hash for each band of `rows` slots, different for each band."""
    grid = found[:, : count * rows].reshape(len(found), count, rows)
    total = np.zeros((len(found), count), np.uint64) + np.arange(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            total = splitmix(total * _BASE + grid[:, :, i])
    return total.view(np.int64)


def banding(similarity: float, missed: float = 1e-6) -> tuple[int, int]:
    """Bands and rows: pairs of just this similarity share no band with a chance of `missed` at most."""
    rows = 6 if similarity >= 0.84 else 5
    count = int(np.ceil(np.log(missed) / np.log1p(-(similarity**rows))))
    return count, rows


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
