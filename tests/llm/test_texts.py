"""Packing, media, byte-level BPE, secrets, fingerprints against plain forms."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from samples import LONG, bag, clashing, docs, rows
from tokenizers import Tokenizer

from sessora.llm import bpe, fingerprints, media, packing, secrets

SF = "/root/testdata/sf0.001"
TEXTS = st.text(alphabet="ast're l\n\t é中1½!\u0085 \x1c😀_.|<", max_size=60)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return docs(spark, [])


# --- packing


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))


@given(st.lists(TEXTS, max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_encoder_equals_tokenizer(encoder, texts):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    assert [i.tolist() for i in encoder(texts)] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_cuts_are_powers_of_two():
    for n in [1, 2, 3, 4095, 4096, 4097, 12345]:
        assert sum(packing.cuts(n)) == n
        assert all(c & (c - 1) == 0 and c <= 4096 for c in packing.cuts(n))
        assert packing.cuts(n) == sorted(packing.cuts(n), reverse=True)


def test_packing_whole_table(spark, table):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.report(packing.pack(table)).collect()
    by_doc = {}
    for r in sorted(found, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in found}) == len(found)
    for r in table.collect():
        ids = np.array(plain.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in by_doc[r.doc_id]:
            assert (p.start, p.doc_tokens, p.offset) == (at, len(ids), 0)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


# --- media


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    image = media.Decoder(media.encode(payload))
    assert image.payload() == payload
    assert image.rgb().shape == (image.height, image.width, 3)


def test_bit_path_equals_byte_path(monkeypatch):
    coded = media.encode(media.pad(random.Random(3).randbytes(3000)))
    fast = media.Decoder(coded)
    monkeypatch.setattr(media, "_byte_table", lambda *a: None)
    slow = media.Decoder(coded)
    for a, b in zip(fast.components, slow.components):
        assert (a.coefficients == b.coefficients).all()


def test_flat_image_decodes_to_its_colour():
    data = np.zeros((6, 64), np.uint8)
    data[:, 0] = 128  # DC 0; AC bytes of 128 are +2, the smallest
    data[:, 1:] = 128
    tensor = media.Decoder(media.encode(data.tobytes())).rgb()
    planes = media.Decoder(media.encode(data.tobytes())).planes()
    block = np.zeros(64)
    block[media.ZIGZAG[1:]] = 2
    assert np.allclose(planes[0][:8, :8], media.DCT.T @ block.reshape(8, 8) @ media.DCT + 128, atol=1e-3)
    assert tensor.dtype == np.uint8


def test_media_rows(spark, table):
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in media.load(media.store(table), tensors=True).collect():
        payload = media.pad(texts[r.doc_id].encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert len(r.tensor) == 3 * r.height * r.width


# --- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    runs = bpe.runs_of(bpe.codepoint_classes())
    return bpe.Codec(public_tokenizers.path(bpe.RANKS), runs)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@given(st.lists(TEXTS, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_library(codec, library, texts):
    found = codec.encode(texts)
    assert [i.tolist() for i in found] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(i, codec.offsets(i)).decode() for i in found] == texts


def test_bpe_long_slices(codec, library):
    texts = ["x" * 5000, "ab" * 3000 + "!" * 700, LONG, " " * 999]
    assert [i.tolist() for i in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_rows(spark, table, library):
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in bpe.report(bpe.round_trip(table)).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- secrets


def test_entropy_of_windows():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdef01", k=80))
    for i, found in enumerate(secrets.entropy_windows(text, 16)):
        part = Counter(text[i : i + 16])
        assert abs(found + sum(c / 16 * np.log2(c / 16) for c in part.values())) < 1e-9


def plain_base(text):
    patterns = {
        "assign": r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    found = []
    for n, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            if len(m.group(2 if kind == "assign" else 0)) >= least[kind]:
                found.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@given(st.text(alphabet="Tokenpaswrd=:\"' AKIABC019f", max_size=80))
@settings(max_examples=200, deadline=None)
def test_base_spans(text):
    base = [s for s in secrets.find_spans(text) if s[2] in secrets.BASE_KINDS]
    assert ",".join(f"{k}:{a}:{b}" for a, b, k in base) == plain_base(text)


def test_secret_rows(spark, table):
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in secrets.report(secrets.scan(table)).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(base.split(",") if base else [])


def test_entropy_finds_keys_and_leaves_words():
    key = "q7Zp2LkX9vBn4TsWc8RmYd3H"
    assert secrets.find_spans(f"use {key} now")[0][2] == "entropy"
    for clean in ("internationalisation-and-localisation", "550e8400-e29b-41d4-a716-446655440000",
                  "2024-01-01/2024-12-31-0000", "path/to/some/very/long/folder/name"):
        assert secrets.find_spans(clean) == []


@pytest.mark.parametrize("length", [20, 24, 40, 64])
def test_random_keys_are_found_whole(length):
    """As many as have a window of high entropy; before, keys with few digits were missed or cut."""
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters + letters.upper() + "0123456789+/", letters + letters.upper(), letters):
        keys = ["".join(rng.choices(alphabet, k=length)) for _ in range(1000)]
        whole = sum(secrets.redact(f"use {k} now") == f"use {secrets.REDACTED} now" for k in keys)
        assert whole >= 0.99 * sum(max(secrets.entropy_windows(k, 20)) >= 3.65 for k in keys)


def test_compound_words_are_no_keys():
    for clean in ("getHttpResponseCodeFromServer", "a_rather_long_function_name_of_words",
                  "Donaudampfschifffahrtsgesellschaft", "order-number-1234567890123456789012",
                  "src/main/resources/templates/index", "anticonstitutionnellement"):
        assert secrets.find_spans(clean) == []


def test_redacted_keeps_rows_and_columns(spark):
    frame = clashing(docs(spark), "spans", "kind")
    clean = secrets.redacted(frame)
    assert clean.columns == frame.columns and clean.count() == frame.count()
    texts = [r.text for r in clean.collect()]
    assert sum(t is None for t in texts) == 2
    assert not any(secrets.find_spans(t) for t in texts if t)
    assert any(t and secrets.REDACTED in t for t in texts)


# --- fingerprints


def plain_phrases(text):
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


@given(st.text(alphabet="abé", max_size=60), st.text(alphabet="abc", max_size=60))
@settings(max_examples=200, deadline=None)
def test_phrases(text, other):
    phrases = fingerprints.Phrases(text)
    cut = lambda t, ends: {t[a:b] for a, b in zip([0, *ends], ends)}
    assert cut(text, phrases.ends) == plain_phrases(text)
    kept = len(text) - len(text) // 4
    changed = text[:kept] + other[: len(text) // 4]
    phrases.exchange(changed, kept)
    assert cut(changed, phrases.ends) == plain_phrases(changed)
    assert fingerprints.Phrases(changed).ends == phrases.ends


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    powers = fingerprints.Powers()
    sets, prints = [], []
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    for keep in (300, 200, 100, 0):
        text = " ".join(words[:keep] + ["".join(rng.choices("klmnop", k=4)) for _ in range(300 - keep)])
        phrases = fingerprints.Phrases(text)
        sets.append(plain_phrases(text))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        prints.append(fingerprints.signature(powers.hashes(points, phrases.ends)))
    for s, p in zip(sets, prints):
        exact = len(s & sets[0]) / len(s | sets[0])
        assert abs(fingerprints.likeness(p, prints[0]) - exact) < 0.15


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_fingerprint_rows(spark, table, chunk):
    ordered = sorted(table.collect(), key=lambda r: r.doc_id)
    found = {r.doc_id: r for r in fingerprints.fingerprint(table, chunk).collect()}
    assert len(found) == len(ordered)
    for this, following in zip(ordered, [*ordered[1:], ordered[0]]):
        r, quarter = found[this.doc_id], len(this.text) // 4
        edited = this.text[: len(this.text) - quarter] + following.text[:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(this.text), hashlib.sha256(edited.encode()).hexdigest())
        their = found[following.doc_id].fingerprint
        assert r.near_next == fingerprints.likeness(r.fingerprint, their)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
    near = [r.near_edited for r in found.values()]
    assert sum(near) / len(near) > 2 * sum(r.near_next for r in found.values()) / len(near)


# --- all


OPERATORS = {
    "packing": lambda d: packing.report(packing.pack(d)).drop("sequence_id"),
    "media": lambda d: media.load(media.store(d)),
    "bpe": lambda d: bpe.report(bpe.round_trip(d)),
    "secrets": lambda d: secrets.report(secrets.scan(d)),
    "fingerprints": fingerprints.fingerprint,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    operator, frame = OPERATORS[name], docs(spark)
    found = operator(frame)
    ids = Counter(r.doc_id for r in found.select("doc_id").collect())
    if name != "packing":
        assert ids == Counter(r[0] for r in rows())
    assert set(ids) == {r[0] for r in rows()}
    clash = clashing(frame, "spans", "media", "ids", "start", "pieces", "fingerprint", "chunk", "key")
    assert bag(operator(clash)) == bag(found)
    assert operator(empty(spark)).count() == 0


# --- random keys of every alphabet

ALPHABETS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "lower and digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "upper and digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_few_of_all_random_keys_are_missed(name):
    rng = random.Random(7)
    for length, most in ((20, 0.03), (24, 0.02), (32, 0.01)):
        keys = ["".join(rng.choices(ALPHABETS[name], k=length)) for _ in range(400)]
        missed = sum(secrets.redact(f"use {k} now") != f"use {secrets.REDACTED} now" for k in keys)
        assert missed <= most * len(keys), (name, length, missed)


def test_example_keys_are_allowed_only_as_a_whole():
    key = "q7Rk2mZx9LpW4vTc8NbY1sHd"
    assert secrets.find_spans("id AKIAIOSF EXAMPLE") == []
    assert secrets.find_spans("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []
    for text in (f"EXAMPLE{key}", f"EXAMPLE={key}", f"EXAMPLE_KEY_{key}"):
        assert [s[2] for s in secrets.find_spans(text)] == ["entropy"], text
