"""Media columns: progressive JPEG, written from bytes and read back into RGB tensors.

`encode` stores bytes without loss as the quantised DCT coefficients of a 4:2:0 progressive JPEG, 64 to
a block: a byte is a coefficient's value, so the bytes come back from the entropy-coded scans whatever
the inverse transform rounds. `Decoder` reads any Huffman-coded progressive JPEG: it accumulates
spectral-selection and successive-approximation scans in coefficient arrays, inverse-transforms them in
numpy, upsamples the chroma and gives a full-resolution RGB tensor. Its bit-by-bit path serves all
streams; scans whose symbols all take one byte, as those of `encode`, are read by a table.

Null and empty texts become one block of zero bytes. Rows are independent; equal texts give equal
media, tensors and features. Texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from sessora.llm.common import map_texts

BLOCK = 64
BANDS = ((1, 5), (6, 63))  # spectral selection of the first scans
_COMMENT = b"payload bytes "


def zigzag_order() -> np.ndarray:
    """Place of each coefficient of a scan in its 8x8 block, row by row."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    walk = sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in walk])


ZIGZAG = zigzag_order()


def transform() -> np.ndarray:
    """The orthonormal DCT-II matrix, frequency by sample."""
    k, n = np.mgrid[0:8, 0:8]
    return np.sqrt((1 + (k > 0)) / 8) * np.cos((2 * n + 1) * k * math.pi / 16)


DCT = transform().astype(np.float32)


# --- Huffman tables ------------------------------------------------------------


def codes_of(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (length, code)."""
    code, at, found = 0, 0, {}
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            found[symbols[at]] = (length, code)
            code, at = code + 1, at + 1
        code <<= 1
    return found


@cache
def _byte_table(counts: tuple[int, ...], symbols: tuple[int, ...], dc: bool) -> np.ndarray | None:
    """Value for each byte, if every symbol with its extra bits is one byte and stands for one value."""
    table = np.full(256, 9999, np.int16)
    for symbol, (length, code) in codes_of(list(counts), list(symbols)).items():
        size = symbol & 15
        if length + size != 8 or symbol > 15 or (size == 0 and not dc):
            return None
        for bits in range(1 << size):
            value = bits if size and bits >> (size - 1) else bits - (1 << size) + 1
            table[code << size | bits] = value
    return table


def _sizes_table(low: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Size s has a code of 8 - s bits, so that code and value together take a byte."""
    sizes = range(7, low - 1, -1)
    counts = [0] * 16
    for s in sizes:
        counts[7 - s] += 1
    return tuple(counts), tuple(sizes)


DC_TABLE = _sizes_table(0)
AC_TABLE = _sizes_table(1)
RUN_TABLE = (tuple([0, 0, 0, 15] + [0] * 12), tuple(n << 4 for n in range(15)))  # block runs only


@cache
def _byte_of(dc: bool) -> np.ndarray:
    """Inverse of _byte_table, by value + 128."""
    table = _byte_table(*(DC_TABLE if dc else AC_TABLE), dc)
    known = np.flatnonzero(table != 9999)
    found = np.zeros(256, np.uint8)
    found[table[known] + 128] = known
    return found


# --- encoding ------------------------------------------------------------------


def pad(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of a block."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def layout(blocks: int) -> tuple[int, int]:
    """Luma blocks across and down, both even, so that luma and quartered chroma hold `blocks`."""
    across = 2 * max(1, math.ceil(math.sqrt(blocks / 6)))
    return across, 2 * math.ceil(blocks / (3 * across))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(place: int, table: tuple) -> bytes:
    return _segment(0xC4, bytes([place, *table[0], *table[1]]))


def _scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([1, component, 0x00, first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(flags: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    return np.packbits(np.append(flags, np.ones(-len(flags) % 8, flags.dtype))).tobytes()


def _refinement(flags: np.ndarray) -> bytes:
    """Correction bits of blocks (rows) in which no coefficient is new."""
    parts = []
    for at in range(0, len(flags), 32767):
        part = flags[at : at + 32767]
        n = len(part).bit_length() - 1
        head = n << n | (len(part) - (1 << n))  # 4 bits of code, n bits of run
        parts += [np.array([head >> i & 1 for i in range(n + 3, -1, -1)], np.uint8), part.ravel()]
    return _bits(np.concatenate(parts))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload, a positive multiple of 64 bytes."""
    blocks = len(payload) // BLOCK
    across, down = layout(blocks)
    luma, chroma = across * down, across * down // 4
    data = np.zeros((luma + 2 * chroma, BLOCK), np.int16)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    dc = data[:, 0] - 128
    ac = np.where(data < 128, -2 - data, data - 126)  # magnitudes of at least 2: none vanishes halved
    magnitude = np.abs(ac)
    halves = np.sign(ac) * (magnitude >> 1)
    first_bytes, refine = _byte_of(False)[halves + 128], (magnitude & 1).astype(np.uint8)
    out = [
        b"\xff\xd8",
        _segment(0xFE, _COMMENT + str(len(payload)).encode()),
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(
            0xC2,
            struct.pack(">BHHB", 8, 8 * down, 8 * across, 3)
            + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]),
        ),
        _huffman(0x00, DC_TABLE),
        _huffman(0x10, AC_TABLE),
    ]
    parts = [(1, 0, luma), (2, luma, luma + chroma), (3, luma + chroma, luma + 2 * chroma)]
    for c, a, b in parts:
        steps = np.diff(dc[a:b] >> 1, prepend=0)
        out.append(_scan(c, 0, 0, 0, 1, _byte_of(True)[steps + 128].tobytes()))
    for low, high in BANDS:
        for c, a, b in parts:
            out.append(_scan(c, low, high, 0, 1, first_bytes[a:b, low : high + 1].tobytes()))
    for c, a, b in parts:
        out.append(_scan(c, 0, 0, 1, 0, _bits((dc[a:b] & 1).astype(np.uint8))))
    out.append(_huffman(0x10, RUN_TABLE))
    for c, a, b in parts:
        out.append(_scan(c, 1, 63, 1, 0, _refinement(refine[a:b, 1:])))
    return b"".join([*out, b"\xff\xd9"])


# --- decoding ------------------------------------------------------------------


class _Bits:
    """Bits of entropy-coded data; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            bit = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1 if self.at < self.end else 1
            value, self.at = value << 1 | bit, self.at + 1
        return value

    def many(self, n: int) -> np.ndarray:
        """n bits at once."""
        first = self.at >> 3
        part = np.frombuffer(self.data[first : first + n // 8 + 2], np.uint8)
        bits = np.unpackbits(part)[self.at & 7 :][:n]
        self.at += n
        return np.append(bits, np.ones(n - len(bits), np.uint8))

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.get((length, code))) is not None:
                return found
        raise ValueError("a code that no Huffman table has")

    def value(self, size: int) -> int:
        bits = self.take(size)
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


class _Component:
    def __init__(self, name: int, across: int, down: int, table: int):
        self.name, self.across, self.down, self.table = name, across, down, table

    def allocate(self, width: int, height: int, most_across: int, most_down: int) -> None:
        """Blocks of the component's own scans, and those that whole MCUs fill."""
        size = lambda n, own, most: -(-(-(-n * own // most)) // 8)
        self.blocks_across = size(width, self.across, most_across)
        self.blocks_down = size(height, self.down, most_down)
        self.columns = -(-width // (8 * most_across)) * self.across
        self.rows = -(-height // (8 * most_down)) * self.down
        self.coefficients = np.zeros((self.rows, self.columns, BLOCK), np.int32)  # in scan order

    def own(self) -> np.ndarray:
        return self.coefficients[: self.blocks_down, : self.blocks_across]


class Decoder:
    """Parses a progressive JPEG into coefficient arrays; `rgb` makes the tensor."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        self.comments: list[bytes] = []
        self.tables: dict[int, tuple] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.components: list[_Component] = []
        at = 2
        while data[at + 1] != 0xD9:
            marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDA:
                end = self._scan_end(data, at)
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDB:
                self._quantiser(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0), 0xDD):
                raise ValueError(f"marker {marker:#x}: only progressive Huffman coding, no restarts")

    @staticmethod
    def _scan_end(data: bytes, at: int) -> int:
        while True:
            at = data.index(b"\xff", at)
            if data[at + 1] != 0:
                return at
            at += 2

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = tuple(body[1:17])
            n = sum(counts)
            self.tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
            body = body[17 + n :]

    def _quantiser(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            end = 1 + 64 * (1 + wide)
            self.quantisers[body[0] & 15] = np.frombuffer(body[1:end], ">u2" if wide else "u1")
            body = body[end:]

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for name, factors, table in struct.iter_unpack("BBB", body[6 : 6 + 3 * n]):
            self.components.append(_Component(name, factors >> 4, factors & 15, table))
        self.most = [max(getattr(c, k) for c in self.components) for k in ("across", "down")]
        for c in self.components:
            c.allocate(self.width, self.height, *self.most)

    def _codes(self, place: int) -> dict[tuple[int, int], int]:
        counts, symbols = self.tables[place]
        return {code: s for s, code in codes_of(list(counts), list(symbols)).items()}

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        named = {c.name: c for c in self.components}
        chosen = [(named[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
        first, last, steps = head[1 + 2 * n : 4 + 2 * n]
        high, low = steps >> 4, steps & 15
        if first == 0:
            (self._dc_refine if high else self._dc_first)(chosen, data, low)
        else:
            (component, tables), = chosen
            scan = self._ac_refine if high else self._ac_first
            scan(component, 0x10 | tables & 15, data, first, last, low)

    def _dc_blocks(self, chosen: list) -> list[tuple[int, np.ndarray]]:
        """Blocks of a DC scan in coded order, each with the place of its component in the scan."""
        if len(chosen) == 1:
            own = chosen[0][0].own()
            return [(0, own[y, x]) for y in range(own.shape[0]) for x in range(own.shape[1])]
        order = []
        for row in range(chosen[0][0].rows // chosen[0][0].down):
            for column in range(chosen[0][0].columns // chosen[0][0].across):
                for i, (c, _) in enumerate(chosen):
                    for y in range(c.down):
                        for x in range(c.across):
                            block = c.coefficients[row * c.down + y, column * c.across + x]
                            order.append((i, block))
        return order

    def _dc_first(self, chosen: list, data: bytes, low: int) -> None:
        tables = [self.tables[t >> 4] for _, t in chosen]
        by_byte = _byte_table(*tables[0], True) if len(chosen) == 1 else None
        if by_byte is not None:
            own = chosen[0][0].own()
            steps = by_byte[np.frombuffer(data, np.uint8, own.shape[0] * own.shape[1])]
            own[..., 0] = np.cumsum(steps, dtype=np.int32).reshape(own.shape[:2]) << low
            return
        bits, codes, last = _Bits(data), [self._codes(t >> 4) for _, t in chosen], [0] * len(chosen)
        for i, block in self._dc_blocks(chosen):
            last[i] += bits.value(bits.symbol(codes[i]))
            block[0] = last[i] << low

    def _dc_refine(self, chosen: list, data: bytes, low: int) -> None:
        if len(chosen) == 1:
            own = chosen[0][0].own()
            flags = _Bits(data).many(own.shape[0] * own.shape[1])
            own[..., 0] |= flags.reshape(own.shape[:2]).astype(np.int32) << low
            return
        bits = _Bits(data)
        for _, block in self._dc_blocks(chosen):
            block[0] |= bits.take(1) << low

    def _ac_first(self, c: _Component, place: int, data: bytes, first: int, last: int, low: int) -> None:
        own, band = c.own(), slice(first, last + 1)
        by_byte = _byte_table(*self.tables[place], False)
        if by_byte is not None:
            values = by_byte[np.frombuffer(data, np.uint8, own[..., band].size)]
            own[..., band] = values.reshape(own[..., band].shape).astype(np.int32) * (1 << low)
            return
        bits, codes, skip = _Bits(data), self._codes(place), 0
        for y in range(own.shape[0]):
            for x in range(own.shape[1]):
                if skip:
                    skip -= 1
                    continue
                k = first
                while k <= last:
                    run, size = divmod(bits.symbol(codes), 16)
                    if size:
                        k += run
                        own[y, x, k] = bits.value(size) * (1 << low)
                        k += 1
                    elif run == 15:
                        k += 16
                    else:
                        skip = (1 << run) + bits.take(run) - 1
                        break

    def _ac_refine(self, c: _Component, place: int, data: bytes, first: int, last: int, low: int) -> None:
        bits, codes, one = _Bits(data), self._codes(place), 1 << low
        own = c.own()
        across, count = own.shape[1], own.shape[0] * own.shape[1]
        at = 0
        while at < count:
            block, k = own[at // across, at % across], first
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if not size and run < 15:
                    blocks = (1 << run) + bits.take(run)
                    self._correct(block[k : last + 1], bits, one)
                    rest = np.arange(at + 1, min(at + blocks, count))
                    if len(rest):
                        part = own[rest // across, rest % across, first : last + 1]
                        self._correct(part, bits, one)
                        own[rest // across, rest % across, first : last + 1] = part
                    at += blocks - 1
                    break
                new = one if size and bits.take(1) else -one
                while k <= last:
                    if block[k]:
                        self._correct(block[k : k + 1], bits, one)
                    elif run == 0:
                        if size:
                            block[k] = new
                        k += 1
                        break
                    else:
                        run -= 1
                    k += 1
            at += 1

    @staticmethod
    def _correct(values: np.ndarray, bits: _Bits, one: int) -> None:
        """A correction bit for each coefficient that is not zero, in order."""
        old = values != 0
        flags = bits.many(int(old.sum())).astype(values.dtype)
        values[old] += np.sign(values[old]) * flags * one

    def payload(self) -> bytes:
        """The bytes that `encode` stored."""
        (size,) = [int(c[len(_COMMENT) :]) for c in self.comments if c.startswith(_COMMENT)]
        every = np.concatenate([c.own().reshape(-1, BLOCK) for c in self.components])
        data = np.where(every < 0, -2 - every, every + 126)
        data[:, 0] = every[:, 0] + 128
        return data.astype(np.uint8).tobytes()[:size]

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, before clipping."""
        found = []
        for c in self.components:
            natural = np.empty(c.coefficients.shape, np.float32)
            natural[..., ZIGZAG] = c.coefficients * self.quantisers[c.table]
            grid = natural.reshape(c.rows, c.columns, 8, 8)
            samples = DCT.T @ grid @ DCT
            found.append(samples.transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns) + 128)
        return found

    def rgb(self) -> np.ndarray:
        """Height x width x 3 of 8 bits; chroma repeated to full resolution."""
        full = []
        for c, plane in zip(self.components, self.planes()):
            plane = np.clip(plane, 0, 255)
            wide, tall = self.most[0] // c.across, self.most[1] // c.down
            plane = plane.repeat(tall, 0).repeat(wide, 1) if wide * tall > 1 else plane
            full.append(plane[: self.height, : self.width])
        if len(full) == 1:
            return np.rint(full[0])[..., None].repeat(3, 2).astype(np.uint8)
        y, blue, red = full[0], full[1] - 128, full[2] - 128
        # The JFIF colour transform.
        colours = (y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue)
        return np.stack([np.clip(np.rint(p), 0, 255).astype(np.uint8) for p in colours], axis=-1)


def features(tensor: np.ndarray) -> str:
    """Size, mean of each colour, and a hash of the brightness steps of a coarse 8 x 9 grid."""
    height, width, _ = tensor.shape
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    means = ",".join(str(int(s) * 1000 // (height * width)) for s in sums)
    grey = tensor[..., 1].astype(np.int64)
    rows = np.add.reduceat(grey, np.arange(8) * height // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(9) * width // 9, axis=1)
    steps = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"size={width}x{height};mean_milli={means};steps={steps}"


# --- DataFrames ----------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `media`, the JPEG that holds the padded text."""

    def start() -> Callable:
        def step(texts, part):
            data = [t.encode() for t in texts]
            return {"n_bytes": [len(d) for d in data], "media": [encode(pad(d)) for d in data]}

        return step

    return map_texts(docs, "n_bytes long, media binary", start)


def load(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Each media row read back: payload digests, feature, and with `tensors` the RGB tensor."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    from sessora.llm.common import slices

    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    new += ", height int, width int, tensor binary" if tensors else ""
    keep = ["doc_id", "n_bytes"]
    schema = T.StructType(
        [stored.schema[c] for c in keep] + T._parse_datatype_string(new).fields
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, "media"):
            rows = [_digest(media, tensors) for media in part.column("media").to_pylist()]
            made = [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, schema=arrow)

    return stored.select(*keep, "media").mapInArrow(run, schema)


def _digest(media: bytes, tensors: bool) -> dict:
    image = Decoder(media)
    payload, tensor = image.payload(), image.rgb()
    row = {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": features(tensor),
    }
    if tensors:
        row |= {"height": tensor.shape[0], "width": tensor.shape[1], "tensor": tensor.tobytes()}
    return row
