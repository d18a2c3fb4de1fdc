"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing over all pieces of a corpus, done on counts: lengths are bounded by the capacity, so the number of
pieces of each length is a small table whatever the corpus. The driver packs that table: lengths go down, and for each
a segment tree over remaining capacities finds the tightest open bins that still fit it, which take as many pieces of
that length as there are bins in one step. This gives exactly the bins of best-fit decreasing over the single pieces.
The steps (at most a few for each length) say which ranks of a length go to which sequences; every piece then looks its
sequence up by its length and its rank, which is a running number that Spark deals out in parallel.

Documents of more than the capacity are cut into pieces; no others are. Null text counts as empty, and an empty text
is one piece of the end id alone. Repeated rows are packed once each; an empty table gives no rows; further columns are ignored. Pieces of equal length
are interchangeable: which of them goes first follows a hash of document, piece, ids and place in the written table, so
repeated rows of one doc_id spread like others.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolode.llm.common import few, saved

CAPACITY = 2048
#: Words that a Python worker keeps (up to twice as many), and the longest of them.
KEPT, KEPT_CHARS = 200_000, 40
#: Texts whose new words are encoded together.
TOGETHER = 64
#: Pieces of one length that one task numbers.
RANKED = 200_000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
NUMBERED = T.StructType([*PIECES, T.StructField("place", T.LongType())])


def _byte_letters() -> dict[int, str]:
    """Letters up to ÿ -> how a byte-level tokenizer writes their lower case: printable bytes as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    written = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(written[b] for b in chr(c).lower().encode()) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº"}


LETTERS = _byte_letters()
#: Letters and ASCII punctuation behind them, which is split off; an apostrophe may begin a word of its own.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


#: How a vocabulary must normalise and split for words to be encoded one by one (fixed values of its file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def known_settings(tokenizer) -> bool:
    """Whether white space only separates words, letters are lower-cased and split off, and no added token has white space or normalised text."""
    about = json.loads(tokenizer.to_str())
    steps = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
    bytes_ = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    plain = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) and not t["content"][:1].isalpha() for t in about.get("added_tokens") or [])
    return bool(about.get("normalizer") == NORMALIZER and split and bytes_ and plain and about["model"]["type"] == "BPE" and not about.get("truncation"))


class _Words(dict):
    """Little-endian ids of words, found as they are asked for; up to twice KEPT stay.

    A word of Latin letters has the ids of its lower case, and the punctuation behind its letters is a word of its own. Such
    letters are left by normalising and never split, so their bytes go straight to the merges.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        #: whether the shortcuts below hold for this vocabulary
        self.known = known_settings(self.tokenizer)
        #: words of the generation before, which come back when they are asked for again
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if m := _WORD.fullmatch(word):
                letters, tail = m[1].lower(), m[2]
                if tail or letters != word:
                    ids = self[letters] + (self[tail] if tail else b"")
                else:
                    found = [t.id for t in self.merges(word.translate(LETTERS))]
                    ids = _PACKED[len(found)](*found) if len(found) < len(_PACKED) else np.array(found, "<u4").tobytes()
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids

    def renew(self) -> None:
        if len(self) > KEPT:
            self.before = dict(self)
            self.clear()


_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


class WordTokenizer:
    """Little-endian ids of texts. If white space only separates words for the tokenizer, words are encoded once and kept; else texts are encoded whole."""

    def __init__(self, path: str):
        self.words = _Words(path)
        self.tokenizer = self.words.tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words.known:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.words.renew()
        found = self.words.__getitem__
        return [b"".join(map(found, t.replace("\n", " ").split(" "))) for t in texts]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for a Python worker."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, the crc32 of its ids and its place in its task's rows; the end id follows each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        place = 0
        for batch in few(batches, TOGETHER):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = [*(list(zip(*rows, strict=True)) or [[]] * 5), range(place, place + len(rows))]
            place += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], NUMBERED.names)

    return docs.select("doc_id", "text").mapInArrow(run, NUMBERED)


class Capacities:
    """Segment tree over remaining capacities 0 to most: which of them have open bins."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, capacity: int, some: bool) -> None:
        k = self.leaves + capacity
        self.some[k] = some
        while k > 1:
            k //= 2
            self.some[k] = self.some[2 * k] or self.some[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of at least ``least``, in logarithmic time."""
        k = self.leaves + least
        if self.some[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.some[k + 1]:  # the subtree to the right
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Steps (length, first rank, first sequence, offset) for counts of pieces by length.

    Pieces of a length from the first rank on, up to the next step of that length, go to as many sequences from the
    first sequence on, at that offset.
    """
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> ranges of sequences (first, number)
    tree, steps, opened = Capacities(capacity), [], 0

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            bins[room].append((first, number))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                first, number, room = opened, -(-left // (capacity // length)), capacity
                opened += number
            else:
                first, number = bins[room].pop()
                if not bins[room]:
                    tree.mark(room, False)
            # a bin stays the tightest while another piece of this length fits, so each takes all it can hold
            fits, offset = room // length, capacity - room
            full = min(number, left // fits)
            part = min(left - full * fits, fits) if full < number else 0
            for k in range(fits if full else 0):
                steps.append((length, rank + k * full, first, offset + k * length))
            rank, left = rank + full * fits, left - full * fits
            for k in range(part):
                steps.append((length, rank + k, first + full, offset + k * length))
            rank, left = rank + part, left - part
            leave(room - fits * length, first, full)
            leave(room - part * length, first + full, bool(part))
            leave(room, first + full + bool(part), number - full - bool(part))
    return steps


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """cut (a written table) with rank, from 0 without gaps within each length. A length of many pieces is numbered by many tasks."""
    spark = cut.sparkSession
    shares = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()] or [(0, 1)], "length long, shares long")
    dealt = cut.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.col("shares"))).drop("shares")  # at most one row for each length
    sums = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "share").count().withColumn("base", F.coalesce(F.sum("count").over(sums), F.lit(0))).drop("count")
    numbered = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32", "place")) - 1)
    return numbered.join(bases, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "share")


def placed(cut: DataFrame, steps: list[tuple[int, int, int, int]]) -> DataFrame:
    """Ranked pieces with sequence_id and offset."""
    table = np.array(sorted(steps), np.int64).reshape(-1, 4)
    lengths, rank, first, offset = table.T
    # one sorted key for length and rank: the last step that begins at or before a piece is its own
    low = {int(n): (int(a), int(b)) for n, a, b in zip(*np.unique(lengths, return_index=True), np.append(np.unique(lengths, return_index=True)[1][1:], len(lengths)), strict=True)} if len(table) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(n), np.int64)
            for one in np.unique(n):
                a, b = low[int(one)]
                own = n == one
                at[own] = a + np.searchsorted(rank[a:b], r[own], "right") - 1
            out = [batch.column(batch.schema.get_field_index(c)) for c in PIECES.names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(first[at] + r - rank[at]), pa.array(offset[at])], SCHEMA.names)

    return cut.mapInArrow(run, SCHEMA)


SCHEMA = T.StructType([*PIECES, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and the offset there, gapless from 0."""
    cut = saved(pieces(docs, tokenizer_path, capacity, end_id))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row for each length up to the capacity
    return placed(ranked(cut, counts), best_fit_decreasing(counts, capacity))
