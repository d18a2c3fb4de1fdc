"""Media columns: bytes kept losslessly in progressive JPEG files, which are read back into RGB tensors.

A payload byte is one quantised DCT coefficient, the unit of the format: 128 magnitudes from 2 to 129 with a sign. 64 bytes make a block in
zigzag order, and the blocks fill the luminance and then the two chroma components of a 4:2:0 image. Each component has four scans: DC,
the bands 1 to 5 and 6 to 63 without their last bit (spectral selection, successive approximation), and the refinement of that
bit. The Huffman tables give every coefficient the same number of bits, code and value together, so numpy
writes and reads the scans of many images at once. ``decode`` reads such scans in one step and any other progressive scan symbol by
symbol; both add to the same coefficient arrays. Then comes the inverse transform, chroma is upsampled by repetition, and the image
becomes a full-resolution tensor of height x width x 3 bytes.

Null text counts as empty; a payload is padded with bytes 0 to a positive multiple of 64. Equal texts give equal files,
tensors and features. Repeated rows, ties and further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: MCUs in a row of an image; payload bytes that are handled at once.
WIDE, TOGETHER = 4000, 4 << 20


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient, along the diagonals."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes (code, bits) of symbols with these lengths."""
    out, code, before = {}, 0, 0
    for symbol, bits in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= bits - before
        out[symbol], code, before = (code, bits), code + 1, bits
    return out


#: Code lengths by symbol: with the value bits, 16 for a DC difference and 8 for an AC value; 1 for the end of a refined block.
DC_LENGTHS = {s: 16 - s for s in range(10)}
AC_LENGTHS = {s: 8 - s for s in range(1, 8)} | {0: 8}
REFINE_LENGTHS = {0: 1}


def _value_bits(v: int, size: int) -> int:
    return v if v > 0 else v + (1 << size) - 1


def _coded(v: int, table: dict[int, tuple[int, int]]) -> int:
    size = abs(v).bit_length()
    return table[size][0] << size | (_value_bits(v, size) if size else 0)


def _values(table: dict[int, tuple[int, int]], bits: int) -> np.ndarray:
    """Value by the next so many bits, if each symbol of the table has them with its value; 0 where none has."""
    out = np.zeros(1 << bits, np.int16)
    for size, (code, length) in table.items():
        if size and length + size == bits:
            low = np.arange(1 << size)
            out[(code << size) + low] = np.where(low >> (size - 1), low, low - (1 << size) + 1)
    return out


# payload byte -> coefficient and back
_COEFFICIENT = np.array([((b & 127) + 2) * (-1 if b >> 7 else 1) for b in range(256)], np.int16)
_BYTE = np.zeros(259, np.uint8)
_BYTE[_COEFFICIENT + 129] = np.arange(256)
# encoding: DC difference -> 16 bits, payload byte -> 8 bits of its first AC scan
_DC = np.array([_coded(d, codes(DC_LENGTHS)) for d in range(-258, 259)], ">u2")
_AC = np.array([_coded(int(np.sign(v)) * (abs(int(v)) >> 1), codes(AC_LENGTHS)) for v in _COEFFICIENT], np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    return _segment(0xC4, bytes([kind << 4 | number]) + bytes(sum(b == n for _, b in order) for n in range(1, 17)) + bytes(s for s, _ in order))


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _table(0, 0, DC_LENGTHS) + _table(1, 0, AC_LENGTHS) + _table(1, 1, REFINE_LENGTHS)
_SCANS = tuple(tuple(_segment(0xDA, bytes([1, c, t, a, b, h])) for t, a, b, h in ((0, 0, 0, 0x00), (0, 1, 5, 0x01), (0, 6, 63, 0x01), (1, 1, 63, 0x10))) for c in (1, 2, 3))


def layout(payload_bytes: int) -> tuple[int, int]:
    """MCUs across and down."""
    mcus = -(-payload_bytes // (6 * UNIT))
    down = -(-mcus // WIDE)
    return -(-mcus // down), down


def encode(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files of payloads, whose lengths are positive multiples of 64."""
    shapes = [layout(len(p)) for p in payloads]
    sizes = [6 * a * d for a, d in shapes]
    raw = np.frombuffer(b"".join(p.ljust(n * UNIT, b"\0") for p, n in zip(payloads, sizes, strict=True)), np.uint8).reshape(-1, UNIT)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    dc = _COEFFICIENT[raw[:, 0]].astype(np.int32)
    diff = np.diff(dc, prepend=0)
    for parts in (0, 4, 5):  # each component's first block
        at = starts[:-1] + np.array(sizes) * parts // 6
        diff[at] = dc[at]
    ac = _AC[raw]
    bits = raw & 1
    bits[:, 0] = 0
    scans = [_DC[diff + 258].tobytes(), ac[:, 1:6].tobytes(), ac[:, 6:].tobytes(), np.packbits(bits, axis=1).tobytes()]
    out = []
    for payload, (across, down), start, n in zip(payloads, shapes, starts[:-1].tolist(), sizes, strict=True):
        frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _TABLES, _segment(0xC2, frame)]
        for k, (a, b) in enumerate(((0, 4), (4, 5), (5, 6))):
            a, b = start + n * a // 6, start + n * b // 6
            for header, data, width in zip(_SCANS[k], scans, (2, 5, 58, 8), strict=True):
                parts += [header, data[a * width : b * width].replace(b"\xff", b"\xff\0")]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[dict[int, tuple[int, int]], dict[int, tuple[int, int]]]]
    first: int
    last: int
    high: int
    low: int
    restart: int
    data: bytes


@dataclass
class Image:
    """What the markers of a file say."""

    height: int = 0
    width: int = 0
    comment: bytes = b""
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)

    def blocks(self, k: int) -> tuple[int, int]:
        """Blocks down and across that the component holds, whole MCUs of them."""
        most_a, most_d = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.height // (8 * most_d)) * self.components[k][2], -(-self.width // (8 * most_a)) * self.components[k][1]

    def own_blocks(self, k: int) -> tuple[int, int]:
        """Blocks down and across of a scan of this component alone."""
        most_a, most_d = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.height * self.components[k][2] // (8 * most_d)), -(-self.width * self.components[k][1] // (8 * most_a))


@functools.lru_cache(maxsize=64)
def _read_tables(body: bytes) -> tuple[tuple[int, dict[int, tuple[int, int]]], ...]:
    out, at = [], 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        symbols = body[at + 17 : at + 17 + sum(counts)]
        lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
        out.append((body[at], codes(dict(zip(symbols, lengths, strict=True)))))
        at += 17 + sum(counts)
    return tuple(out)


def parse(file: bytes) -> Image:
    image, tables, at, restart = Image(), {}, 2, 0
    while at < len(file):
        marker = file[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(file[at + 2 : at + 4])
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quantisers[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int32)
                k += 1 + 64 * (wide + 1)
        elif marker == 0xC4:
            tables.update(_read_tables(body))
        elif marker == 0xDD:
            restart = int.from_bytes(body)
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError(f"frame type {marker:x} isn't progressive Huffman coding")
        elif marker == 0xDA:
            n, end = body[0], at
            while True:  # up to a marker that is neither a stuffed byte nor a restart
                end = file.index(b"\xff", end)
                if file[end + 1] and not 0xD0 <= file[end + 1] <= 0xD7:
                    break
                end = end + 2
            ids = [c[0] for c in image.components]
            own = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            image.scans.append(Scan([c for c, _ in own], [(tables.get(t >> 4, {}), tables.get(16 | t & 15, {})) for _, t in own], body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, restart, file[at:end]))
            at = end
    return image


class _Bits:
    """Bits of a scan between restarts, most significant first."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\0", b"\xff")
        self.value, self.left = int.from_bytes(data), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1) if self.left >= 0 else (1 << n) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (code, n) in table:
                return table[code, n]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def read_slowly(image: Image, scan: Scan, arrays: list[np.ndarray]) -> None:
    """Adds a scan of any form to the coefficient arrays (down, across, 64), symbol by symbol."""
    if len(scan.components) == 1:
        down, across = image.own_blocks(scan.components[0])
        units = [[(0, i, j)] for i in range(down) for j in range(across)]
    else:
        h = [image.components[c] for c in scan.components]
        down, across = (n // s for n, s in zip(image.blocks(scan.components[0]), (h[0][2], h[0][1]), strict=True))
        units = [[(k, i * c[2] + y, j * c[1] + x) for k, c in enumerate(h) for y in range(c[2]) for x in range(c[1])] for i in range(down) for j in range(across)]
    reading = [tuple({v: s for s, v in t.items()} for t in pair) for pair in scan.tables]
    every = scan.restart or len(units)
    pieces = [p[2 * (k > 0) :] for k, p in enumerate(_cut_restarts(scan.data))] if scan.restart else [scan.data]
    one = 1 << scan.low
    for piece, at in zip(pieces, range(0, len(units), every), strict=False):
        bits, before, run = _Bits(piece), [0] * len(scan.components), 0
        for k, i, j in (b for unit in units[at : at + every] for b in unit):
            block, (dc, ac) = arrays[scan.components[k]][i, j], reading[k]
            if scan.first == 0:
                if scan.high:
                    block[0] |= bits.take(1) << scan.low
                else:
                    before[k] += bits.number(bits.symbol(dc))
                    block[0] = before[k] << scan.low
                continue
            z = scan.first
            while not run and z <= scan.last:
                zeros, size = divmod(bits.symbol(ac), 16)
                if not size and zeros < 15:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                value = bits.number(size) * one if size else 0
                while z <= scan.last:  # past so many zeros; in a refinement, coefficients known before get a bit each
                    if block[z]:
                        if scan.high and bits.take(1):
                            block[z] += one if block[z] > 0 else -one
                    elif not zeros:
                        break
                    else:
                        zeros -= 1
                    z += 1
                if z <= scan.last and value:
                    block[z] = value
                z += 1
            if run:
                if scan.high:
                    for z in range(z, scan.last + 1):
                        if block[z] and bits.take(1):
                            block[z] += one if block[z] > 0 else -one
                run -= 1


def _cut_restarts(data: bytes) -> list[bytes]:
    cuts = [k for k in range(len(data) - 1) if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7]
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


@functools.lru_cache(maxsize=64)
def _one_step(items: tuple[tuple[int, tuple[int, int]], ...], bits: int) -> np.ndarray | None:
    """Values by bits if all of a table's symbols with a value take so many."""
    table = dict(items)
    even = table and all(s < 16 and (not s or n + s == bits) for s, (_, n) in table.items()) and (bits == 8 or table.get(0, (0, bits))[1] == bits)
    return _values(table, bits) if even else None


def coefficients(images: list[Image]) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Coefficients of all blocks in zigzag order, and for each image and component its first block, blocks down and across."""
    places, n = [], 0
    for image in images:
        places.append([])
        for k in range(len(image.components)):
            down, across = image.blocks(k)
            places[-1].append((n, down, across))
            n += down * across
    all_blocks = np.zeros((n, 64), np.int16)
    # scans of one kind are read together, the first of each image before the second
    for turn in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[tuple[Image, Scan, int, int, bytes]]] = {}
        for image, own in zip(images, places, strict=True):
            if turn >= len(image.scans):
                continue
            scan = image.scans[turn]
            c = scan.components[0]
            first, down, across = own[c]
            data = scan.data.replace(b"\xff\0", b"\xff")
            width = 2 if scan.first == 0 else 8 if scan.high else scan.last - scan.first + 1
            alone = len(scan.components) == 1 and not scan.restart and image.own_blocks(c) == (down, across) and len(data) == width * down * across
            table = tuple(scan.tables[0][scan.first > 0].items())
            even = alone and not (scan.first == 0 and scan.high) and (scan.high and (scan.first, scan.last) == (1, 63) and table == ((0, (0, 1)),) or not scan.high and _one_step(table, 16 if scan.first == 0 else 8) is not None)
            key = (scan.first, scan.last, scan.high, scan.low, table) if even else (id(scan),)
            kinds.setdefault(key, []).append((image, scan, first, down * across, data))
        for key, some in kinds.items():
            if len(key) == 1 or not _read_together(key, some, all_blocks):
                for image, scan, *_ in some:
                    own = places[next(k for k, i in enumerate(images) if i is image)]
                    read_slowly(image, scan, [all_blocks[a : a + d * w].reshape(d, w, 64) for a, d, w in own])
    return all_blocks, places


def _read_together(key: tuple, some: list, all_blocks: np.ndarray) -> bool:
    """Adds even scans of one kind in one step; False if a symbol without a value, or a block with zeros to refine, is among them."""
    first, last, high, low, table = key
    raw = np.frombuffer(b"".join(s[4] for s in some), np.uint8)
    at = np.concatenate([np.arange(s[2], s[2] + s[3]) for s in some])
    if high:
        bits = np.unpackbits(raw).reshape(-1, 64)
        blocks = all_blocks[at]
        if bits[:, 0].any() or not blocks[:, 1:].all():
            return False
        all_blocks[at, 1:] = blocks[:, 1:] + np.sign(blocks[:, 1:]) * (bits[:, 1:].astype(np.int16) << low)
    elif first == 0:
        step = np.cumsum(_one_step(table, 16)[raw.view(">u2")].astype(np.int64))
        heads = np.cumsum([0, *(s[3] for s in some[:-1])])
        before = np.repeat(np.concatenate([[0], step[heads[1:] - 1]]), [s[3] for s in some])
        all_blocks[at, 0] = (step - before) << low
    else:
        values = _one_step(table, 8)[raw].reshape(-1, last - first + 1)
        if not values.all():
            return False
        all_blocks[at, first : last + 1] = values << low
    return True


def _transform() -> np.ndarray:
    """64 x 64 matrix from zigzag coefficients to samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.einsum("ui,vj->uvij", basis, basis).reshape(64, 64)[ZIGZAG]


_INVERSE = _transform()


def tensors(images: list[Image], blocks: np.ndarray, places: list[list[tuple[int, int, int]]]) -> Iterator[np.ndarray]:
    """An RGB tensor (height, width, 3) of each image."""
    scaled = blocks.astype(np.float64)
    for image, own in zip(images, places, strict=True):
        for c, (a, down, across) in zip(image.components, own, strict=True):
            if (q := image.quantisers[c[3]]).max() > 1:
                scaled[a : a + down * across] *= q
    # a hair above a half, so that ties don't hang on the order of sums
    samples = np.clip(np.floor(scaled @ _INVERSE + (128.5 + 1e-7)), 0, 255).astype(np.uint8)
    for image, own in zip(images, places, strict=True):
        most_a, most_d = max(c[1] for c in image.components), max(c[2] for c in image.components)
        planes = []
        for c, (a, down, across) in zip(image.components, own, strict=True):
            plane = samples[a : a + down * across].reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
            if (most_d, most_a) != (c[2], c[1]):
                plane = plane.repeat(most_d // c[2], 0).repeat(most_a // c[1], 1)
            planes.append(plane[: image.height, : image.width].astype(np.int32))
        y, cb, cr = planes if len(planes) == 3 else (planes[0], np.int32(128), np.int32(128))
        cb, cr = cb - 128, cr - 128
        # the format's usual factors, in 65536ths
        rgb = np.empty((*y.shape, 3), np.uint8)
        for k, v in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
            rgb[..., k] = np.clip(y + (v + 32768 >> 16), 0, 255)
        yield rgb


def payloads(images: list[Image], blocks: np.ndarray, places: list[list[tuple[int, int, int]]]) -> list[bytes]:
    """The bytes that encode() stored."""
    raw = _BYTE[blocks + 129].tobytes()
    return [raw[own[0][0] * UNIT : own[0][0] * UNIT + struct.unpack(">Q", image.comment)[0]] for image, own in zip(images, places, strict=True)]


def feature(rgb: np.ndarray) -> str:
    """Shape, channel means and the mean step between neighbours in green, from whole sums."""
    n = rgb.shape[0] * rgb.shape[1]
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // n
    green = rgb[..., 1].astype(np.int16)
    step = int(np.abs(green[:, 1:] - green[:, :-1]).sum(dtype=np.int64)) * 1000 // n
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(str(int(m)) for m in means) + f";{step}"


COLUMNS = "doc_id bigint, n_bytes bigint, jpeg binary, payload binary, height int, width int, rgb binary, feature string"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_rgb: bool = True) -> DataFrame:
    """A row per text: doc_id, n_bytes, the file (jpeg), the payload read back from it, height, width, rgb (null unless kept) and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(ids):
                end, size = at + 1, len(texts[at])
                while end < len(ids) and size + len(texts[end]) <= TOGETHER:
                    size += len(texts[end])
                    end += 1
                some = texts[at:end]
                files = encode([t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b"\0") for t in some])
                images = [parse(f) for f in files]
                blocks, places = coefficients(images)
                rgb = list(tensors(images, blocks, places))
                columns = [ids[at:end], [len(t) for t in some], files, payloads(images, blocks, places), [i.height for i in images], [i.width for i in images], [r.tobytes() if keep_rgb else None for r in rgb], [feature(r) for r in rgb]]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "jpeg", "payload", "height", "width", "rgb", "feature"])
                at = end

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, COLUMNS)
