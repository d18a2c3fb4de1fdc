"""Resampling towards a target distribution by hashed word n-grams, with word tries inside partitions.

Each task counts its texts in a trie: a node is a run of words and holds the state of the CRC of its words, joined by one space, and how often each word
followed it; a longer run continues the state of the shorter one. A trie that reaches ``NODES`` is added to the task's bucket totals and begun anew, which changes nothing but
memory. Tasks give one row per bucket; these are summed by bucket, for the documents and for the target. A bucket's gain is
the logarithm of the target's share over the documents' share. Documents are then scored by walking trie paths whose nodes have the gains attached,
and Gumbel noise from a hash of the key turns taking the highest scores into sampling without replacement.

Only bucket totals (their number is a parameter) reach the driver. Scores are ordered by range: every task numbers its own range, and no
text is moved for it. Very long texts are cut into words a piece at a time. Null text has no words; documents without words have weight 0 and, as all with fewer than
``least_words`` words, are never drawn. Rows with a null key are hashed as an empty one and come first among equal scores. Repeated rows count, and are drawn, each by
itself. Without documents or without a target there are no features on that side, and the smoothing decides. Further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import few, saved, without_clash
from geolode.plans.storage import placed_in_order

#: Nodes of a trie, and bytes of a text that are cut into words at once.
NODES, PIECE = 1 << 18, 1 << 20
#: Bytes to words: ASCII letters in lower case, digits and all bytes beyond ASCII stay, the rest separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.translate(_WORDS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Node:
    """A run of words: the CRC state behind it, the numbers of the runs that are one word longer, by that word, and the nodes of those that go on from there."""

    __slots__ = ("state", "numbers", "below")

    def __init__(self, state: int | None, numbers: dict[bytes, int]) -> None:
        self.state, self.numbers, self.below = state, numbers, {}

    def after(self, word: bytes) -> int:
        return zlib.crc32(word) if self.state is None else zlib.crc32(word, zlib.crc32(b" ", self.state))


class Gains(dict):
    """Gains by the word that follows a node, found by the CRC state where a word comes first."""

    def __init__(self, by_bucket: list[int], before: int | None) -> None:
        self.by_bucket, self.node = by_bucket, Node(before, self)

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.by_bucket[self.node.after(word) % len(self.by_bucket)]
        return found


class WordTrie:
    """Runs of up to width words, with the numbers that numbers(state) begins for a node. When it has grown beyond NODES, full says so, and it may be cleared between two texts or pieces."""

    def __init__(self, width: int, numbers: Callable[[int | None], dict[bytes, int]]) -> None:
        self.width, self.numbers = width, numbers
        self.clear()

    def clear(self) -> None:
        self.top, self.inner = Node(None, self.numbers(None)), 0

    def full(self) -> bool:
        return len(self.top.numbers) + self.inner > NODES

    def runs(self, words: list[bytes], starts: int) -> Iterator[tuple[dict[bytes, int], bytes]]:
        """The numbers and the last word of every run that begins at one of the first starts words."""
        for at in range(starts):
            node = self.top
            for word in words[at : at + self.width - 1]:
                yield node.numbers, word
                under = node.below.get(word)
                if under is None:
                    state = node.after(word)
                    under = node.below[word] = Node(state, self.numbers(state))
                    self.inner += 1
                node = under
            if at + self.width <= len(words):
                self.inner += words[at + self.width - 1] not in node.numbers
                yield node.numbers, words[at + self.width - 1]

    def nodes(self) -> Iterator[Node]:
        waiting = [self.top]
        while waiting:
            node = waiting.pop()
            waiting += node.below.values()
            yield node


def _windows(text: bytes, width: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text a piece at a time, with the last ones of the piece before that begin longer runs, and how many of them begin a run now."""
    rest: list[bytes] = []
    for words in _pieces(text):
        words = rest + words
        starts = max(0, len(words) - width + 1)
        rest = words[starts:]
        yield words, starts
    if rest:
        yield rest, len(rest)


def count(trie: WordTrie, text: bytes, settle: Callable[[], None]) -> None:
    """Adds the runs of a text to a trie of Counters; settle takes the counts over and clears it."""
    for words, starts in _windows(text, trie.width):
        if trie.width == 1:
            trie.top.numbers.update(words)
        else:
            for numbers, word in trie.runs(words, starts):
                numbers[word] += 1
        if trie.full():
            settle()


def walk(trie: WordTrie, text: bytes) -> tuple[int, int, int]:
    """Words, runs and sum of gains of a text, along the paths of a trie of Gains."""
    n_words = n_runs = weight = 0
    for words, starts in _windows(text, trie.width):
        n_words += starts
        if trie.width == 1:
            n_runs += starts
            weight += sum(map(trie.top.numbers.__getitem__, words))
        else:
            for numbers, word in trie.runs(words, starts):
                n_runs += 1
                weight += numbers[word]
        if trie.full():
            trie.clear()
    return n_words, n_runs, weight


def bucket_totals(df: DataFrame, text: str = "text", width: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = WordTrie(width, lambda state: Counter()), np.zeros(buckets, np.int64)

        def settle() -> None:
            for node in trie.nodes():
                n = len(node.numbers)
                at = np.fromiter((node.after(word) % buckets for word in node.numbers), np.int64, n)
                np.add.at(totals, at, np.fromiter(node.numbers.values(), np.int64, n))
            trie.clear()

        for batch in few(batches):
            for value in batch.column(0):
                count(trie, value.as_py() or b"", settle)
        settle()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])

    counted = df.select(F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # as many rows as buckets at most
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor of 1000 times the logarithm of the target's smoothed share over the documents'."""
    k, s, t = len(documents), int(documents.sum()), int(target.sum())
    share = lambda a, b: float(b + 1) * float(s + k) / (float(a + 1) * float(t + k))
    return np.array([math.floor(1000 * math.log(share(a, b))) for a, b in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: int | str | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, width: int = 1, seed: str = "2024", key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep of it) with n_words, n_features, weight and score, which replace columns of these names."""
    new = ["n_words", "n_features", "weight", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    mark = without_clash(docs)
    by_bucket = gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(width, lambda state: Gains(by_bucket, state))
        for batch in few(batches):
            rows = []
            for name, value in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                n_words, n_runs, weight = walk(trie, value.as_py() or b"")
                rows.append((n_words, n_runs, weight, weight + noise(name.as_py(), seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*keep, *new])

    given = docs.select(*keep, F.col(key).cast("string").alias(f"{mark}key"), F.col(text).cast("string").cast("binary").alias(f"{mark}text"))
    schema = docs.select(*keep).schema
    for c in new:
        schema = schema.add(c, "long")
    return given.mapInArrow(run, schema)


def learned(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, text: str = "text", target_text: str = "text") -> np.ndarray:
    return gains(bucket_totals(docs, text, width, buckets), bucket_totals(target, target_text, width, buckets))


def ranked(scores: DataFrame, key: str = "doc_id", least_words: int = 20, percent: int = 10) -> DataFrame:
    """scores (key, n_words, n_features, weight, score) with rank: 1, 2, 3 ... of the floor(percent * N / 100) highest scores of the N documents with at least least_words words, ties to the smaller key; null for the rest. Scores are read several times; pass a saved table."""
    fit = F.col("n_words") >= least_words
    placed = placed_in_order(scores.filter(fit), F.desc("score"), F.asc(key), "n_words", "weight")
    drawn = percent * placed.count() // 100
    return placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place").unionByName(scores.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of docs with all their columns, n_words, n_features, weight and score.

    Scores alone are ordered; what they give is the score and key of the last row drawn, and documents are scored again and kept up to there. Of rows equal to
    the last one in both, as many as belong to the draw are taken.
    """
    gain = learned(docs, target, width, buckets, text)
    fit = scored(docs, gain, width, seed, key, text).filter(F.col("n_words") >= least_words)
    scores = saved(scored(docs, gain, width, seed, key, text, [key]).filter(F.col("n_words") >= least_words).select("score", key))
    placed = placed_in_order(scores, F.desc("score"), F.asc(key))
    drawn = percent * placed.count() // 100
    last = placed.filter(F.col("place") == drawn).select("score", key).first()
    if last is None:
        return fit.filter(F.lit(False))
    same = (F.col("score") == last[0]) & F.col(key).eqNullSafe(F.lit(last[1]))
    before = F.col(key) < F.lit(last[1]) if last[1] is not None else F.lit(False)
    above = (F.col("score") > last[0]) | ((F.col("score") == last[0]) & ~same & (F.col(key).isNull() | before))
    ends = placed.filter(same).agg(F.min("place"), F.max("place")).first()
    if ends[1] == drawn:
        return fit.filter(same | F.coalesce(above, F.lit(False)))
    place = f"{without_clash(docs)}place"
    ties = placed_in_order(fit.filter(same), "score", name=place).filter(F.col(place) <= drawn - ends[0] + 1).drop(place)
    return fit.filter(F.coalesce(above, F.lit(False))).unionByName(ties)


CRC_TABLE = "(SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"


def crc_sql(value: str) -> str:
    """The CRC-32 of a string's bytes, where the table crc (t) is in scope."""
    return f"xor(list_reduce([4294967295] || list_transform(range(length(hex(encode({value}))) // 2), lambda i: ('0x' || hex(encode({value}))[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL = rf"""
WITH crc AS {CRC_TABLE},
d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT unnest({_words_sql("coalesce(text, '')")}) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS word FROM d),
c AS (SELECT word, sum(n) AS n, sum(m) AS m FROM (SELECT word, 1 AS n, 0 AS m FROM u UNION ALL SELECT word, 0, 1 FROM b) q GROUP BY word),
k AS (SELECT word, n, m, {crc_sql("word")} % 10000 AS bucket FROM c, crc),
s AS (SELECT bucket, sum(n) AS s, sum(m) AS t FROM k GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s, a),
v AS (SELECT u.doc_id, sum(g.gain) AS weight FROM u JOIN k ON u.word = k.word JOIN g ON k.bucket = g.bucket GROUP BY u.doc_id),
o AS (
  SELECT d.doc_id, len(w) AS n, coalesce(v.weight, 0) AS weight,
         coalesce(v.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('2024:' || d.doc_id)[1:8]) AS BIGINT) + 0.5e0) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN v ON d.doc_id = v.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM o WHERE n >= 20)
SELECT o.doc_id, CAST(o.n AS BIGINT) AS n_features, CAST(o.weight AS BIGINT) AS weight, CAST(o.score AS BIGINT) AS score,
       CAST(CASE WHEN place <= 10 * total // 100 THEN place END AS BIGINT) AS rank
FROM o LEFT JOIN r ON o.doc_id = r.doc_id
"""
