"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word stems, pairs of neighbours and pairs with one
word between of a text, hashed to ``DIMENSIONS`` places. Per-coordinate rates let rare features learn
fast; L1 keeps most weights at zero, so the weights are few and broadcast. How strong it is, the
fit finds within the training rows: of L1S, the value with the least log loss on every
fifth of them, learned from the others.

Cases: a null or empty text has the bias only and gets its score; labels that are null
are no training rows; of rows that repeat an id each is used and scored; rows that tie in the sample's order
go by label, then features; without training rows, all scores are 0.5; an empty table gives an
empty result. Whole
texts are taken; columns besides id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hash_sample, saved
from .kernels import ASCII_LOWER, chunks, mix, span_hashes, word_spans

DIMENSIONS = 1 << 20
#: The fit's bounds: labelled rows with the least hash of the id, as far as their features come to TRAIN_FEATURES.
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 40_000_000
EPOCHS, ALPHA, BETA, L2 = 4, 1.0, 1.0, 1.0
#: Values of L1 that are tried, and the share of the training rows that they are tried on.
L1S, FOLDS = (0.5, 1.5, 3.0, 6.0), 5
#: Besides whole words, their first bytes, so that inflected forms share a feature.
STEMS = (4, 5)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of each row, by row."""
    starts, ends, row = word_spans(data, offsets, _LETTER)
    word = span_hashes(ASCII_LOWER[data], starts, ends)
    parts, rows = [word], [row]
    for gap in (1, 2):
        inside = row[gap:] == row[:-gap]
        parts.append(mix(word[:-gap] * np.uint64(2 * gap + 1) + word[gap:])[inside] if len(word) > gap else word[:0])
        rows.append(row[:-gap][inside] if len(word) > gap else row[:0])
    for length in STEMS:
        longer = ends - starts > length
        parts.append(span_hashes(ASCII_LOWER[data], starts[longer], starts[longer] + length) + np.uint64(length))
        rows.append(row[longer])
    place = (mix(np.concatenate(parts)) & np.uint64(dimensions - 1)).astype(np.int64)
    both = np.unique(np.concatenate(rows) * dimensions + place)
    return both // dimensions, both % dimensions


class Ftrl:
    """FTRL-proximal state of a logistic regression with 0/1 features."""

    def __init__(self, l1: float, dimensions: int = DIMENSIONS):
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
        self.l1 = l1

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _passes(rows: list[tuple], l1: float) -> Ftrl:
    model = Ftrl(l1)
    for _ in range(EPOCHS):
        for _, y, at in rows:
            model.update(at, y)
    return model


def best_l1(rows: list[tuple]) -> float:
    """Of L1S, the value with the least log loss on the rows whose order is divisible by FOLDS, learned from the others; the least one of equals."""
    inner, outer = [r for r in rows if r[0] % FOLDS], [r for r in rows if not r[0] % FOLDS]

    def loss(l1: float) -> float:
        w = _passes(inner, l1).weights(slice(None))
        margins = np.array([w[at].sum() * (1 if y else -1) for _, y, at in outer])
        return float(np.logaddexp(0, -np.clip(margins, -35, 35)).sum())

    return min(L1S, key=loss) if outer else L1S[0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero; the last place, DIMENSIONS, is the bias.

    ``labels`` holds the training rows alone. Sample ids are bounded and broadcast; the
    texts are turned into features where they lie, and one task runs the passes over
    the sample, which TRAIN_ROWS and TRAIN_FEATURES bound.
    """
    sample = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    sample = saved(hash_sample(sample.distinct(), "_id", TRAIN_ROWS, 11))
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("_id")).select("_order", "_label", text_col)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                row, place = hashed_features(data, offsets)
                bounds = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], batch.column(1)[first:end], lists], ["o", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(o, y, np.append(np.asarray(x.values, np.int32), np.int32(DIMENSIONS))) for b in batches for o, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        seen.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        w = _passes(seen, best_l1(seen)).weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    features = saved(rows.mapInArrow(featurize, "o long, y int, at array<int>"))
    sizes = sorted(map(tuple, features.groupBy("o").agg(F.sum(F.size("at"))).collect()))  # a row per row of the sample, at most
    fits = np.cumsum([n for _, n in sizes]) <= TRAIN_FEATURES
    last = max((o for (o, _), ok in zip(sizes, fits) if ok), default=-1)
    found = features.where(F.col("o") <= last).repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)


def score_toxicity(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score and predicted of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(DIMENSIONS + 1)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            margin = np.full(len(batch), dense[DIMENSIONS])
            for first, end, data, offsets in chunks(batch.column(1)):
                row, place = hashed_features(data, offsets)
                margin[first:end] += np.bincount(row, weights=dense[place], minlength=end - first)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
