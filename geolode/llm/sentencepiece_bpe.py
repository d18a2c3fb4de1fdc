"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

A text becomes the piece sequence that merging (highest score first, leftmost among equals) would leave. Instead of
merging, ``Encoder`` walks the text with the longest pieces that an Aho-Corasick automaton finds and keeps a piece only
if it is compatible with the one before, which means that merging both pieces' characters again gives these two pieces. Where no
piece fits, the walk goes back; a bitfield of failed positions keeps it from trying an end twice. Compatible neighbours
all along make the whole sequence the merged one, so the result is exact.

No piece reaches from another character into a space mark, nor over a line end, so a text is cut there into chunks that are encoded alone;
frequent chunks come from a bounded memory. Runs of several space marks have one score for all their pieces, which
the argument above doesn't cover; chunks with such runs are merged directly, as is a chunk through which no path of whole pieces leads. (Of
232,084 chunks of 3,000 documents of the test tables none was either.)

Null texts count as empty; an empty text has only the begin and end ids and decodes to an empty text. Repeated rows,
ties and further columns change nothing; one row comes out per row.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geolode.llm.common import few

MARK, NEVER, NONE, PAIR = "▁", float("-inf"), -(1 << 30), 4_000_000
#: Chunks that a Python worker keeps, the longest of them, and pairs of pieces; up to twice as many stay.
KEPT, KEPT_CHARS, KEPT_PAIRS = 250_000, 40, 400_000


class Encoder:
    """Pieces of a model and the walk over a text. Ids of characters without a piece are negative: -1 - code point."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        #: what decoding appends for an id
        self.raw = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.raw[self.unknown] = model.decode([self.unknown]).encode()
        self.text = {i: p for p, i in self.ids.items()}
        self.sizes = [len(self.text.get(i, "")) for i in range(n)]
        #: pieces that merging their characters gives; of each, the next shorter one that begins it
        whole = {p: i for p, i in self.ids.items() if self.merged(p) == [i]}
        self.shorter = [NONE] * n
        self.finder = ahocorasick.Automaton()
        for piece, i in whole.items():
            self.shorter[i] = next((whole[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in whole), NONE)
            self.finder.add_word(piece, (len(piece), i))
        self.finder.make_automaton()
        #: what is known of pairs and chunks; the generation before comes back when it is asked for again
        self.fits: dict[int, bool] = {}
        self.fits_before: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.kept_before: dict[str, bytes] = {}
        # texts stay as they are, but for spaces as marks and one in front
        for text in ("ﬁ Ａ  x ", "\u00a0e\u0301 \n\t y", " a"):
            assert model.normalize(text) == MARK + text.replace(" ", MARK), "the model normalises texts"
        assert not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.ids), "pieces reach over chunk borders"

    def merged(self, chars: str) -> list[int]:
        """Ids by merging neighbours, the highest score first, the leftmost of equals."""
        if len(chars) <= 24:  # short ones without a heap
            left = list(chars)
            scores = [self.score.get(a + b, NEVER) for a, b in zip(left, left[1:], strict=False)]
            while scores and (most := max(scores)) > NEVER:
                k = scores.index(most)
                left[k : k + 2] = [left[k] + left[k + 1]]
                del scores[k]
                if k:
                    scores[k - 1] = self.score.get(left[k - 1] + left[k], NEVER)
                if k < len(scores):
                    scores[k] = self.score.get(left[k] + left[k + 1], NEVER)
            return [self.ids.get(p, -1 - ord(p[0]) if len(p) == 1 else self.unknown) for p in left]
        parts: list[str | None] = list(chars)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if a >= 0 and b < len(parts) and (score := self.score.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, both))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], after[a] = both, None, after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [self.ids.get(p, -1 - ord(p[0]) if len(p) == 1 else self.unknown) for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives both again; negative ids are characters without a piece."""
        pair = a * PAIR + b
        known = self.fits.get(pair)
        if known is None:
            known = self.fits_before.get(pair)
            if known is None:
                spell = lambda i: self.text[i] if i >= 0 else chr(-1 - i)
                known = self.merged(spell(a) + spell(b)) == [a, b]
            if len(self.fits) >= KEPT_PAIRS:
                self.fits_before, self.fits = self.fits, {}
            self.fits[pair] = known
        return known

    def walked(self, chunk: str) -> list[int]:
        """Ids of a chunk by backtracking."""
        n, fits, sizes, shorter = len(chunk), self.fits, self.sizes, self.shorter
        longest = [NONE] * n
        for last, (size, piece) in self.finder.iter(chunk):  # of one start, the longer come later
            longest[last + 1 - size] = piece
        open_ends = bytearray(b"\1") * (n + 1)
        path: list[int] = []
        place, piece = 0, longest[0]
        if piece == NONE:
            piece = -1 - ord(chunk[0])
        while True:
            if piece == NONE:
                if not path:
                    return self.merged(chunk)
                open_ends[place] = 0
                piece = path.pop()
                place -= sizes[piece] if piece >= 0 else 1
            else:
                end = place + (sizes[piece] if piece >= 0 else 1)
                if open_ends[end]:
                    fit = not path or fits.get(path[-1] * PAIR + piece)
                    if fit is None:
                        fit, fits = self.compatible(path[-1], piece), self.fits
                    if fit:
                        path.append(piece)
                        if end == n:
                            return path
                        place, piece = end, longest[end]
                        if piece == NONE:
                            piece = -1 - ord(chunk[end])
                        continue
            piece = shorter[piece] if piece >= 0 else NONE

    def chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a chunk."""
        packed = self.kept_before.get(chunk)
        if packed is None:
            ids = self.merged(chunk) if MARK * 2 in chunk else self.walked(chunk)
            if min(ids) < 0:  # characters without a piece: their bytes
                ids = [x for i in ids for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()])]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= KEPT_CHARS:
            self.kept[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text, without begin and end."""
        if not text:
            return b""
        if len(self.kept) >= KEPT:
            self.kept_before, self.kept = self.kept, {}
        kept, out = self.kept, []
        for line in (MARK + text.replace(" ", MARK)).split("\n"):
            out.append(self.newline)
            # each chunk: a run of space marks and what follows up to the next
            first, *rest = line.split(MARK)
            if first:
                out.append(kept.get(first) or self.chunk(first))
            if MARK * 2 in line or line.endswith(MARK):
                out += [kept.get(c) or self.chunk(c) for c in re.findall(f"{MARK}+[^{MARK}]*", line)]
            else:
                out += [kept.get(c) or self.chunk(c) for c in [MARK + r for r in rest]]
        return b"".join(out[1:])

    @functools.cached_property
    def newline(self) -> bytes:
        return np.array([self.ids["\n"]] if "\n" in self.ids else [self.byte_ids[10]], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; control ids have none, and the first space, which encoding puts in front, goes."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    """One for a Python worker."""
    return Encoder(model_path)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, ids (little-endian unsigned 32-bit, with begin and end) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (coder.begin, coder.end))
        for batch in few(batches):
            ids = [begin + coder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, SCHEMA)
