"""Secret scan: fixed patterns, plus sliding-window Shannon entropy over candidate strings.

Null and empty texts give no spans. Rows are independent, so repeated rows give repeated results.
Spans are code points, end exclusive, ordered by start, then by kind as in KINDS. The whole text is
scanned, whatever its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from sessora.llm.common import bound_batches, map_texts, over_texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")
REDACTED = "[REDACTED]"

# The base patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as with '+', of 24 characters or more

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Alphabets of candidate strings: characters, window, bits a character from which a window counts. The limits lie
#: below what 99 of 100 random keys of 24 characters reach in their best window, for keys of letters
#: alone too; base64 stands for mixed case.
CLASSES = (
    ("hex", _DIGITS + "abcdefABCDEF", 16, 2.5),
    ("lower", _LOWER + _DIGITS, 20, 3.2),
    ("upper", _UPPER + _DIGITS, 20, 3.2),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/=_-", 20, 3.6),
)
#: Digits and letters that a window of hex has at least: words and numbers have few of one.
_HEX_MIXED = 3
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_RUNS = {name: re.compile(f"[{re.escape(chars)}]{{{window},}}") for name, chars, window, _ in CLASSES}
#: Strings of high entropy that are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9/_+=-]+"),  # dates, telephone and other numbers
    re.compile(r"[A-Za-z0-9+/]*EXAMPLE(KEY)?"),  # keys of documentation, which end so
)

#: How much likelier a pair of letters is in words than by chance: 4 + log2 of the ratio, 0 to 8; a row
#: for each first letter. From words of German, English, Spanish, French texts and of program code.
_PAIRS = (
    "43664032621547432676731010"  # a
    "20006000120500500100200030"  # b
    "30004008803300600104100000"  # c
    "42028002500202700233301000"  # d
    "74566433722758543876642425"  # e
    "30003200400200400312200000"  # f
    "51006002200202100132200000"  # g
    "64208024502403520345222002"  # h
    "42637421310448732457130101"  # i
    "50001000000000000000000000"  # j
    "00005000000000000000000000"  # k
    "61228400600610400133300050"  # l
    "41007000500010330010100000"  # m
    "64577174523544633558443002"  # n
    "43443520621348332674712000"  # o
    "60004500200300420303100010"  # p
    "00000000000000000000700000"  # q
    "64428043512334521645322022"  # r
    "53636035520341423447400020"  # s
    "63317018701312520644422035"  # t
    "42308311400436432534120600"  # u
    "30006000500000300000000000"  # v
    "30001005300000100100000000"  # w
    "30203000100110211203010000"  # x
    "10002001100001120022000000"  # y
    "21103000100010000001500000"  # z
)
_CASE_CHANGE, _LETTER_DIGIT, _OTHER = -1.3, -2.0, 0.0  # the same of other neighbours, in bits
_WORDS = -8.0  # bits of a window's neighbours, above which it is words; random ones have about -20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return found


def entropy_windows(string: str, window: int) -> list[float]:
    """Shannon entropy in bits of each window of the string, from counts updated per step."""
    logs = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, result = 0.0, []  # total: sum of c log2 c over the window's characters
    for i, char in enumerate(string):
        count = counts.get(char, 0)
        total += logs[count + 1] - logs[count]
        counts[char] = count + 1
        if i >= window:
            gone = string[i - window]
            count = counts[gone]
            total += logs[count - 1] - logs[count]
            counts[gone] = count - 1
        if i >= window - 1:
            result.append(math.log2(window) - total / window)
    return result


def _allowed(string: str) -> bool:
    return any(p.fullmatch(string) for p in ALLOWED)


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Runs of a class's characters that hold a window of high entropy that is neither words nor a number.

    A run counts from end to end, in candidates that no allow-list entry explains.
    """
    found = []
    for match in _CANDIDATE.finditer(text):
        candidate, at = match.group(), match.start()
        if _allowed(candidate):
            continue
        for name, _, window, bits in CLASSES:
            for run in _RUNS[name].finditer(candidate):
                if _counts(run.group(), name, window, bits):
                    found.append((at + run.start(), at + run.end()))
    return [(a, b, "entropy") for a, b in _united(found)]


def _counts(string: str, name: str, window: int, bits: float) -> bool:
    """Whether a window of a run has high entropy and is neither words nor a number."""
    entropies = entropy_windows(string, window)
    if max(entropies) < bits:
        return False
    letters = [0, *accumulate(map(str.isalpha, string))]
    likeness = [0.0, *accumulate(map(_pair_bits, " " + string, string, string[1:]))]
    for i, entropy in enumerate(entropies):
        own = letters[i + window] - letters[i]
        if name == "hex":
            random = _HEX_MIXED <= own <= window - _HEX_MIXED
        else:
            random = own and likeness[i + window - 1] - likeness[i] <= _WORDS
        if entropy >= bits and random:
            return True
    return False


def _pair_bits(before: str, a: str, b: str) -> float:
    """How much likelier the neighbours a, b are in words than by chance, in bits."""
    if a.isalpha() and b.isalpha():
        if a.isupper() != b.isupper() and (b.isupper() or before.isupper()):
            return _CASE_CHANGE
        return int(_PAIRS[26 * ((ord(a) | 32) - 97) + (ord(b) | 32) - 97]) - 4.0
    return _LETTER_DIGIT if a.isalnum() and b.isalnum() and a.isdigit() != b.isdigit() else _OTHER


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text; entropy adds only what lies in no base span."""
    base = base_spans(text)
    more = [x for x in entropy_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, placeholder: str = REDACTED) -> str:
    """The text with every span, overlapping ones united, replaced."""
    spans = _united([(a, b) for a, b, _ in find_spans(text)])
    parts, last = [], 0
    for a, b in spans:
        parts += [text[last:a], placeholder]
        last = b
    return "".join([*parts, text[last:]]) if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end), of every row."""

    def start() -> Callable:
        def step(texts, part):
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t)] for t in texts]
            return {"spans": rows}

        return step

    return map_texts(docs, "spans array<struct<kind string, start long, end long>>", start)


def redacted(docs: DataFrame) -> DataFrame:
    """The same columns and rows, secrets in `text` replaced, `n_chars` (if there) of the new text.

    A null text stays null.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    clean = F.when(text.isNotNull(), over_texts(text, "string", lambda: lambda texts: [redact(t) for t in texts]))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        length = F.when(text == clean, F.col("n_chars")).otherwise(F.length(clean).cast("long"))
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def joined_spans(spans) -> F.Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(text, ",")


def report(found: DataFrame) -> DataFrame:
    """Per scanned row: spans counted by base kind, digest of the base spans, all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
