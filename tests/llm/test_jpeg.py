"""The progressive JPEG reader against files of an encoder of its own: 4:2:0, interleaved DC, several bands, successive approximation, end-of-band runs, restarts."""

import math
import struct

import numpy as np
import pytest

from geolode.llm import progressive_jpeg as J

WIDE, HIGH = 44, 27  # not whole MCUs
FACTORS = [(2, 2), (1, 1), (1, 1)]
ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 == 0 else c[0]))


class Bits:
    """Symbols and bits of a scan; codes have one length for all symbols."""

    def __init__(self):
        self.items, self.used = [], set()

    def symbol(self, s):
        self.items.append((s, None))
        self.used.add(s)

    def bits(self, value, n):
        self.items.append((value, n))

    def restart(self, k):
        self.items.append(("restart", k))

    def done(self):
        order = sorted(self.used) or [0]
        length = max(1, math.ceil(math.log2(len(order) + 1)))
        out, text = b"", ""

        def packed(text):
            text += "1" * (-len(text) % 8)
            return b"".join(bytes([int(text[k : k + 8], 2)]) + (b"\0" if text[k : k + 8] == "1" * 8 else b"") for k in range(0, len(text), 8))

        for value, n in self.items:
            if value == "restart":
                out, text = out + packed(text) + bytes([0xFF, 0xD0 + n % 8]), ""
            else:
                text += f"{order.index(value):0{length}b}" if n is None else f"{value:0{n}b}" if n else ""
        return order, length, out + packed(text)


def magnitude(bits, v):
    size = abs(v).bit_length()
    bits.bits(v if v > 0 else v + (1 << size) - 1, size)


def down(v, low):
    return int(math.copysign(abs(v) >> low, v))


class Bands:
    """AC scans of one component."""

    def __init__(self, bits, first, last, high, low):
        self.out, self.first, self.last, self.high, self.low, self.run, self.waiting = bits, first, last, high, low, 0, []

    def flush(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.out.symbol(n << 4)
            self.out.bits(self.run - (1 << n), n)
            self.run = 0
        for b in self.waiting:
            self.out.bits(b, 1)
        self.waiting = []

    def block(self, c):
        (self.refine if self.high else self.begin)(c)
        if self.run == 0x7FFF or len(self.waiting) > 900:
            self.flush()

    def begin(self, c):
        zeros = 0
        for k in range(self.first, self.last + 1):
            v = down(c[k], self.low)
            if not v:
                zeros += 1
                continue
            self.flush()
            while zeros > 15:
                self.out.symbol(0xF0)
                zeros -= 16
            self.out.symbol(zeros << 4 | abs(v).bit_length())
            magnitude(self.out, v)
            zeros = 0
        self.run += zeros > 0

    def refine(self, c):
        v = [abs(x) >> self.low for x in c]
        newest = max((k for k in range(self.first, self.last + 1) if v[k] == 1), default=-1)
        zeros, known = 0, []
        for k in range(self.first, self.last + 1):
            if not v[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= newest:
                self.flush()
                self.out.symbol(0xF0)
                for b in known:
                    self.out.bits(b, 1)
                zeros, known = zeros - 16, []
            if v[k] > 1:
                known.append(v[k] & 1)
                continue
            self.flush()
            self.out.symbol(zeros << 4 | 1)
            self.out.bits(int(c[k] > 0), 1)
            for b in known:
                self.out.bits(b, 1)
            zeros, known = 0, []
        if zeros or known:
            self.run += 1
            self.waiting += known


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def written(coefs, quantisers, restart):
    """coefs: by component (down, across, 64), in whole MCUs."""
    mcus = (-(-HIGH // 16), -(-WIDE // 16))
    own = [(-(-HIGH * v // 16), -(-WIDE * h // 16)) for h, v in FACTORS]
    file = b"\xff\xd8" + b"".join(segment(0xDB, bytes([k]) + bytes(q)) for k, q in enumerate(quantisers))
    file += segment(0xC2, struct.pack(">BHHB", 8, HIGH, WIDE, 3) + b"".join(bytes([k + 1, h << 4 | v, min(k, 1)]) for k, (h, v) in enumerate(FACTORS)))
    file += segment(0xDD, struct.pack(">H", restart)) if restart else b""

    def scan(parts, first, last, high, low, bits):
        order, length, data = bits.done()
        kind = 0 if first == 0 else 1
        table = segment(0xC4, bytes([kind << 4]) + bytes(len(order) if n == length else 0 for n in range(1, 17)) + bytes(order))
        return table + segment(0xDA, bytes([len(parts), *(x for k in parts for x in (k + 1, 0)), first, last, high << 4 | low])) + data

    for high, low in ((0, 1), (1, 0)):
        bits, before = Bits(), [0, 0, 0]
        for n in range(mcus[0] * mcus[1]):
            if restart and n and n % restart == 0:
                bits.restart(n // restart - 1)
                before = [0, 0, 0]
            i, j = divmod(n, mcus[1])
            for k, (h, v) in enumerate(FACTORS):
                for y in range(v):
                    for x in range(h):
                        dc = int(coefs[k][i * v + y, j * h + x, 0])
                        if high:
                            bits.bits(dc >> low & 1, 1)
                        else:
                            d = (dc >> low) - before[k]
                            before[k] = dc >> low
                            bits.symbol(abs(d).bit_length())
                            magnitude(bits, d) if d else None
        file += scan([0, 1, 2], 0, 0, high, low, bits)
    for first, last, high, low in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)):
        for k in range(3):
            bits = Bits()
            bands = Bands(bits, first, last, high, low)
            for n in range(own[k][0] * own[k][1]):
                if restart and n and n % restart == 0:
                    bands.flush()
                    bits.restart(n // restart - 1)
                bands.block([int(x) for x in coefs[k][n // own[k][1], n % own[k][1]]])
            bands.flush()
            file += scan([k], first, last, high, low, bits)
    return file + b"\xff\xd9", own


def pixels(coefs, quantisers):
    """By the textbook sums, one sample after another."""
    basis = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)]
    planes = []
    for k, c in enumerate(coefs):
        d, a, _ = c.shape
        plane = np.zeros((8 * d, 8 * a))
        for i in range(d):
            for j in range(a):
                square = np.zeros((8, 8))
                for z, (y, x) in enumerate(ZIGZAG):
                    square[y, x] = c[i, j, z] * quantisers[min(k, 1)][z]
                plane[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] = np.array(basis) @ square @ np.array(basis).T
        plane = np.clip(np.floor(plane + 128.5 + 1e-7), 0, 255)
        planes.append(plane.repeat(2 // FACTORS[k][1], 0).repeat(2 // FACTORS[k][0], 1)[:HIGH, :WIDE])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("dense", [0.03, 0.3, 0.95])
def test_files_of_another_encoder(restart, dense):
    rng = np.random.default_rng(int(100 * dense) + restart)
    mcus = (-(-HIGH // 16), -(-WIDE // 16))
    quantisers = [rng.integers(1, 4, 64).tolist(), rng.integers(1, 6, 64).tolist()]
    coefs = []
    for h, v in FACTORS:
        c = np.where(rng.random((mcus[0] * v, mcus[1] * h, 64)) < dense, rng.integers(-9, 10, (mcus[0] * v, mcus[1] * h, 64)), 0)
        c[:, :, 0] = rng.integers(-200, 200, c.shape[:2])
        coefs.append(c)
    file, own = written(coefs, quantisers, restart)
    for c, (d, a) in zip(coefs, own):  # AC of blocks outside the picture isn't stored
        c[d:, :, 1:], c[:, a:, 1:] = 0, 0
    image = J.parse(file)
    assert len(image.scans) == 14 and (image.width, image.height) == (WIDE, HIGH)
    blocks, places = J.coefficients([image])
    for c, (at, d, a) in zip(coefs, places[0]):
        assert (blocks[at : at + d * a].reshape(d, a, 64) == c).all()
    rgb = next(J.tensors([image], blocks, places))
    assert rgb.shape == (HIGH, WIDE, 3) and np.abs(rgb - pixels(coefs, quantisers)).max() <= 1


def test_texts_longer_than_a_round_and_their_features(spark, monkeypatch):
    monkeypatch.setattr(J, "TOGETHER", 4096)
    texts = [None, "", "short", "x" * 20_000, "é" * 3000, "x" * 20_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in J.media_columns(docs).collect()}
    for k, t in enumerate(texts):
        raw, r = (t or "").encode(), rows[k]
        assert bytes(r.payload) == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0") and r.n_bytes == len(raw)
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3).astype(int)
        n = r.height * r.width
        step = sum(abs(int(a) - int(b)) for line in rgb[..., 1] for a, b in zip(line, line[1:])) * 1000 // n
        assert r.feature == f"{r.height}x{r.width};" + ",".join(str(int(rgb[..., c].sum()) * 1000 // n) for c in range(3)) + f";{step}"
        image = J.parse(bytes(r.jpeg))
        blocks, places = J.coefficients([image])
        assert next(J.tensors([image], blocks, places)).tobytes() == bytes(r.rgb)
    assert rows[3].jpeg == rows[5].jpeg and rows[0].jpeg == rows[1].jpeg
