"""Quality classifier: kernel ridge by random Fourier features over document statistics, calibrated by isotonic regression.

Each text becomes a short vector of statistics. Random cosine features of the standardised vector approximate a Gaussian
kernel; every task sums the normal equations of its labelled rows, Spark adds these sums up, and the driver solves a system
whose size is a parameter. Labelled rows that were kept out of the sums give the isotonic (pool adjacent violators) map from ridge
score to probability, fitted on counts in a fixed number of score bins. What reaches the driver has a fixed size, whatever the corpus.

Only texts are inputs of a score. Null texts count as empty, and empty texts get the score of their statistics like others. Labels
that are null, or whose document is missing, are not used; without usable labels each score is ``NO_LABELS``. A document
with several labels counts with each. Repeated rows are each scored, further columns ignored or passed on; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import BROADCAST_BYTES, few, saved
from geolode.llm.quality_rules import STOP_WORDS

COSINES, RIDGE, SEED, BINS = 128, 1e-3, 7, 1000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD, NO_LABELS = 0.3, 0.5

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER, _LOWER, _DIGIT, _SPACE = (np.array([c in s for c in range(256)]) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c"))
_SYMBOL, _PUNCTUATION = (np.array([c in s for c in range(256)]) for s in (b"#*$%&|<>", b".,;:?'\"()-"))
NAMES = ("chars", "words", "word_length", "upper", "digits", "symbols", "shouts", "punctuation", "beyond_ascii", "space", "lines", "distinct_words", "distinct_lines", "stop_words", "compressed", "longest_word")


def statistics(text: str | None) -> list[float]:
    """The vector of a text, in the order of NAMES."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    letters = max(int(seen[_UPPER].sum() + seen[_LOWER].sum()), 1)
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        min((n - seen[_SPACE].sum()) / m, 40.0),
        seen[_UPPER].sum() / letters,
        seen[_DIGIT].sum() / n,
        seen[_SYMBOL].sum() / m,
        seen[33] / m,
        seen[_PUNCTUATION].sum() / n,
        seen[128:].sum() / n,
        seen[_SPACE].sum() / n,
        float(np.log1p(len(words) / len(lines))),
        len(set(words)) / m / (1.0 + 0.15 * np.log1p(m)),
        len(set(lines)) / len(lines),
        sum(map(_STOP.__contains__, raw.lower().split())) / m,
        min(len(zlib.compress(raw, 1)) / n, 2.0),
        float(np.log1p(max(map(len, words), default=0))),
    ]


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its vector f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            f = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f], ["doc_id", "f"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id bigint, f array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


@dataclass(frozen=True)
class Model:
    """Standardisation, cosines, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), np.ones((len(f), 1))])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(f), NO_LABELS)
        return np.clip(np.interp(self.raw(f), self.knots, self.levels), 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that fit() would use, if the labels are few enough to be broadcast; else all of them."""
    keys = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = keys.count()
    return docs.join(F.broadcast(keys), "doc_id", "left_semi") if 16 * n <= BROADCAST_BYTES else docs


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising means, by pooling neighbours that fall. x rises; total is the sum of labels."""
    pools: list[list[float]] = []
    for a, t, w in zip(x, total, weight, strict=True):
        pools.append([a, a, t, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, b, t1, w1 = pools.pop()
            pools[-1] = [pools[-1][0], b, pools[-1][2] + t1, pools[-1][3] + w1]
    return np.array([p[k] for p in pools for k in (0, 1)]), np.array([p[2] / p[3] for p in pools for _ in (0, 1)])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, cosines: int = COSINES) -> Model:
    """A model from the statistics of documents and labels (doc_id, quality), without the held-out fold."""
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"), fold(F.col("doc_id")).alias("fold")).filter(F.col("fold") != HELD_OUT)
    rows = saved(stats.join(known, "doc_id"))
    d = len(NAMES)
    train = rows.filter(F.col("fold") != CALIBRATION)
    moments = train.agg(F.count("*").alias("n"), *[f(F.col("f")[k]).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(SEED)
    waves, phases = rng.normal(0, 1 / np.sqrt(d), (d, cosines)), rng.uniform(0, 2 * np.pi, cosines)
    none = np.zeros(0)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), waves, phases, np.zeros(cosines + 1), none, none)
    mean, scale = (np.array([moments[f"{f}{k}"] for k in range(d)]) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, phases, np.zeros(cosines + 1), none, none)
    upper = np.triu_indices(cosines + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((cosines + 1, cosines + 1)), np.zeros(cosines + 1)
        for batch in batches:
            z = model.features(_vectors(batch.column(0)))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy()
        values = np.concatenate([a[upper], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "value"])

    summed = train.select("f", "y").mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(len(upper[0]) + cosines + 1)
    for r in summed.collect():  # as many rows as the triangle has cells
        cells[r["cell"]] = r["value"]
    a = np.zeros((cosines + 1, cosines + 1))
    a[upper] = cells[: len(upper[0])]
    a = a + np.triu(a, 1).T + RIDGE * moments["n"] * np.diag([1.0] * cosines + [0.0])
    weights = np.linalg.solve(a, cells[len(upper[0]) :])
    model = Model(mean, model.scale, waves, phases, weights, none, none)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor(model.raw(_vectors(batch.column(0))) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    held = rows.filter(F.col("fold") == CALIBRATION).select("f", "y").mapInArrow(binned, "bin bigint, y double")
    bins = sorted((r["bin"], r["y"], r["n"]) for r in held.groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect())  # a row for each bin at most
    if not bins:
        return Model(mean, model.scale, waves, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    x, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
    return Model(mean, model.scale, waves, phases, weights, *isotonic((x + 0.5) / BINS, y, n))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(f) if len(f) else np.zeros(0))], ["doc_id", "score"])

    df = stats.mapInArrow(run, "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier) and predicted (1 from THRESHOLD on)."""
    stats = saved(with_statistics(docs))
    return scored(stats, fit(stats, labels))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text is predicted 1."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            f = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(f) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
