"""Adaptive arithmetic coding as chunk tables use it: range coding with renewed frequency models, and an integer corrector.

The constants and update rules belong to the file format. The coder keeps its low end as a whole number of any size, so
carries need no care.
"""

from __future__ import annotations

from bisect import bisect_right

#: Fixed values of the format.
LEAST, FULL, SYMBOL_BITS, BIT_BITS = 1 << 24, (1 << 32) - 1, 15, 13


class SymbolModel:
    """Frequencies of n symbols, scaled to 2**15."""

    def __init__(self, n: int):
        self.counts, self.total, self.cycle = [1] * n, 0, n
        self._renew()
        self.cycle = self.left = (n + 6) // 2

    def _renew(self) -> None:
        self.total += self.cycle
        if self.total > 1 << SYMBOL_BITS:
            self.counts = [(c + 1) // 2 for c in self.counts]
            self.total = sum(self.counts)
        scale, so_far, self.starts = 0x80000000 // self.total, 0, []
        for count in self.counts:
            self.starts.append(scale * so_far >> (31 - SYMBOL_BITS))
            so_far += count
        self.cycle = self.left = min(5 * self.cycle // 4, (len(self.counts) + 6) * 8)

    def span(self, symbol: int, length: int) -> tuple[int, int]:
        """The symbol's part of a range of that length."""
        step = length >> SYMBOL_BITS
        return self.starts[symbol] * step, length if symbol + 1 == len(self.starts) else self.starts[symbol + 1] * step

    def find(self, value: int, length: int) -> int:
        return bisect_right(self.starts, value // (length >> SYMBOL_BITS)) - 1

    def saw(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self._renew()


class BitModel:
    """Frequency of 0 among bits, scaled to 2**13."""

    def __init__(self):
        self.zeros, self.total, self.zero, self.cycle, self.left = 1, 2, 1 << (BIT_BITS - 1), 4, 4

    def span(self, bit: int, length: int) -> tuple[int, int]:
        cut = self.zero * (length >> BIT_BITS)
        return (cut, length) if bit else (0, cut)

    def find(self, value: int, length: int) -> int:
        return int(value >= self.zero * (length >> BIT_BITS))

    def saw(self, bit: int) -> None:
        self.zeros += not bit
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << BIT_BITS:
            self.total, self.zeros = (self.total + 1) // 2, (self.zeros + 1) // 2
            self.total += self.zeros == self.total
        self.zero = self.zeros * (0x80000000 // self.total) >> (31 - BIT_BITS)
        self.cycle = self.left = min(5 * self.cycle // 4, 64)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        self.value, self.length = int.from_bytes(data[:4].ljust(4, b"\0")), FULL

    def _take(self, low: int, high: int) -> None:
        self.value, self.length = self.value - low, high - low
        while self.length < LEAST:
            following = self.data[self.at] if self.at < len(self.data) else 0
            self.value, self.length, self.at = self.value << 8 | following, self.length << 8, self.at + 1

    def next(self, model: SymbolModel | BitModel) -> int:
        symbol = model.find(self.value, self.length)
        self._take(*model.span(symbol, self.length))
        model.saw(symbol)
        return symbol

    def bits(self, n: int) -> int:
        """n bits of equal chance; of more than 19 the low 16 come first."""
        if n > 19:
            low = self.bits(16)
            return self.bits(n - 16) << 16 | low
        step = self.length >> n
        found = self.value // step
        self._take(found * step, (found + 1) * step)
        return found


class Encoder:
    def __init__(self):
        self.low, self.length, self.bytes = 0, FULL, 4

    def _take(self, low: int, high: int) -> None:
        self.low, self.length = self.low + low, high - low
        while self.length < LEAST:
            self.low, self.length, self.bytes = self.low << 8, self.length << 8, self.bytes + 1

    def put(self, model: SymbolModel | BitModel, symbol: int) -> None:
        self._take(*model.span(symbol, self.length))
        model.saw(symbol)

    def put_bits(self, n: int, value: int) -> None:
        if n > 19:
            self.put_bits(16, value & 0xFFFF)
            return self.put_bits(n - 16, value >> 16)
        step = self.length >> n
        return self._take(value * step, (value + 1) * step)

    def done(self) -> bytes:
        return self.low.to_bytes(self.bytes)


class Corrector:
    """Integers of 32 bits as corrections of predictions, by context."""

    HIGH = 8

    def __init__(self, contexts: int = 2):
        self.sizes = [SymbolModel(33) for _ in range(contexts)]
        self.zero = BitModel()
        self.values: dict[int, SymbolModel] = {}

    def model(self, k: int) -> SymbolModel:
        """The model of the highest bits of corrections of k bits, made when one comes: a small table has few of them."""
        if k not in self.values:
            self.values[k] = SymbolModel(1 << min(k, self.HIGH))
        return self.values[k]

    def decode(self, coder: Decoder, prediction: int, context: int) -> int:
        k = coder.next(self.sizes[context])
        if k == 0:
            c = coder.next(self.zero)
        elif k == 32:
            c = -(1 << 31)
        else:
            c = coder.next(self.model(k))
            if k > self.HIGH:
                c = c << (k - self.HIGH) | coder.bits(k - self.HIGH)
            c += 1 if c >= 1 << (k - 1) else 1 - (1 << k)
        return _signed(prediction + c)

    def encode(self, coder: Encoder, prediction: int, value: int, context: int) -> None:
        c = _signed(value - prediction)
        k = (-c if c <= 0 else c - 1).bit_length()
        coder.put(self.sizes[context], k)
        if k == 0:
            coder.put(self.zero, c)
        elif k < 32:
            c -= 1 if c > 0 else 1 - (1 << k)
            if k > self.HIGH:
                coder.put(self.model(k), c >> (k - self.HIGH))
                coder.put_bits(k - self.HIGH, c & ((1 << (k - self.HIGH)) - 1))
            else:
                coder.put(self.model(k), c)


def _signed(v: int) -> int:
    return (v + (1 << 31)) % (1 << 32) - (1 << 31)


def decode_sizes(data: bytes, n: int) -> list[int]:
    """Byte sizes of n chunks, each predicted by the one before."""
    coder, corrector, sizes = Decoder(data), Corrector(), []
    for _ in range(n):
        sizes.append(corrector.decode(coder, sizes[-1] if sizes else 0, 1))
    return sizes


def encode_sizes(sizes: list[int]) -> bytes:
    coder, corrector, before = Encoder(), Corrector(), 0
    for size in sizes:
        corrector.encode(coder, before, size, 1)
        before = size
    return coder.done()
