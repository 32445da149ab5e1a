"""Operator 4: document quality from pooled random-indexing vectors and a small network.

A text is cut into units: runs of letters, digits and anything outside ASCII, lower-cased, and
runs of ASCII marks. A word in capitals and a word that repeats the one before it count as units
of their own. Units are hashed into ``BUCKETS`` buckets.

1. Random indexing: each bucket has a fixed sparse index vector (one +1, one -1 in ``DIMENSIONS``).
   A bucket's word vector is the sum of the index vectors of the units up to ``REACH`` places around it,
   over the whole corpus. Each task sums a table of fixed size; the tables are added up in blocks.
2. A document's vector is the mean of its units' normalised word vectors, with its log length.
3. A two-layer network is fitted on a seeded sample of at most ``train_rows`` labelled documents. A
   temperature, fitted on a fifth of them kept apart, makes its outputs probabilities.

Only rows whose crc32 of the ``doc_id`` as text is no multiple of 5 are learned from. ``doc_id``, language
and source never enter a score. Null and empty texts have the zero vector and get a score like any other.
Null ids count as held out; null labels are not learned from; repeated rows are scored each. Without
labels of both kinds every score is the share of good labels (one half without any). Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.frames import flat_texts, slices
from millrace.llm.sums import summed

BUCKETS, DIMENSIONS, REACH = 1 << 15, 32, 2
TRAIN_ROWS, HIDDEN, EPOCHS, SEED = 20_000, 32, 40, 11
KEEP_FROM = 0.3

_CAPITALS, _AGAIN = (np.uint64(x << 49) for x in (3, 5))  # buckets 3 and 5
_KIND = np.where(words.WORD_BYTES, 1, np.where(words.INK_BYTES, 2, 0)).astype(np.int8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_SMALL = np.array([97 <= b <= 122 for b in range(256)])


def units(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, units of each text and the units' buckets, about a megabyte of texts at a time."""
    data, offsets = flat_texts(column)
    for first, last in slices(offsets, words.SLICE_BYTES):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        kind = _KIND[part]
        change = np.ones(len(part) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[own] = True
        edges = np.flatnonzero(change)
        if len(edges) < 2:
            yield first, np.zeros(last - first, np.int64), np.zeros(0, np.int64)
            continue
        ink = kind[edges[:-1]] > 0
        starts, ends = edges[:-1][ink], edges[1:][ink]
        size = 1 << max(10, len(part).bit_length())
        total = np.concatenate(([np.uint64(0)], np.cumsum(words._LOWER[part] * words._powers(words._BASE, size)[: len(part)])))
        hashes = words.mixed((total[ends] - total[starts]) * words._powers(words._INVERSE, size)[starts])
        counts = np.diff(np.searchsorted(starts, own))
        upper, small = (np.concatenate(([0], np.cumsum(t[part]))) for t in (_UPPER, _SMALL))
        capitals = (upper[ends] - upper[starts] >= 2) & (small[ends] == small[starts])
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (kind[starts[1:]] == 1)
        hashes[capitals] = _CAPITALS
        hashes[again] = _AGAIN
        yield first, counts, (hashes >> np.uint64(49)).astype(np.int64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector has its +1 and its -1."""
    rng = np.random.default_rng(SEED)
    plus = rng.integers(0, DIMENSIONS, BUCKETS)
    return plus, (plus + rng.integers(1, DIMENSIONS, BUCKETS)) % DIMENSIONS


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The normalised word vector of every bucket, from all texts: a table of fixed size."""
    plus, minus = _index_vectors()

    def add(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, counts, bucket in units(batch.column("text")):
            text = np.repeat(np.arange(len(counts)), counts)
            for step in range(1, REACH + 1):
                same = text[step:] == text[:-step]
                a, b = bucket[:-step][same], bucket[step:][same]
                for at, other in ((a, b), (b, a)):
                    np.add.at(table, at * DIMENSIONS + plus[other], 1)
                    np.add.at(table, at * DIMENSIONS + minus[other], -1)

    table = summed(docs.select(F.col("text").cast("string")), BUCKETS * DIMENSIONS, add)
    table = table.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text: mean word vector and log length."""
    out = np.zeros((len(column), DIMENSIONS + 1), np.float32)
    for first, counts, bucket in units(column):
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            out[first + some, :DIMENSIONS] = np.add.reduceat(vectors[bucket], starts, axis=0) / counts[some, None]
            out[first + some, DIMENSIONS] = np.log1p(counts[some])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-logits((x - self.mean) / self.scale, self.layers) / self.temperature))


def logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.clip(np.tanh(x @ w1 + b1) @ w2 + b2, -60, 60)[:, 0]


def _fit_layers(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam on the cross entropy, in float64."""
    rng = np.random.default_rng(SEED)
    layers = [
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1),
    ]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            hidden = np.tanh(x[at] @ layers[0] + layers[1])
            out = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -60, 60)))
            d_out = (out - y[at, None]) / len(at)
            d_hidden = d_out @ layers[2].T * (1 - hidden**2)
            grads = [x[at].T @ d_hidden + 1e-4 * layers[0], d_hidden.sum(0), hidden.T @ d_out + 1e-4 * layers[2], d_out.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy, by golden section on its logarithm."""

    def loss(t: float) -> float:
        u = z / np.exp(t)
        return float(np.mean(np.logaddexp(0, u) - y * u))

    low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The network on four fifths of the rows, its temperature on the rest."""
    x = x.astype(np.float64)
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        layers = [np.zeros((DIMENSIONS + 1, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))])]
        return Model(np.zeros(DIMENSIONS + 1), np.ones(DIMENSIONS + 1), layers, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    apart = np.random.default_rng(SEED).permutation(len(x)) % 5 == 0
    layers = _fit_layers(x[~apart], y[~apart])
    usable = len(np.unique(y[apart])) == 2
    return Model(mean, scale, layers, _temperature(logits(x[apart], layers), y[apart]) if usable else 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, vectors, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels`` (``doc_id``, ``quality`` 0 or 1); ``vectors``: the broadcast word vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), vectors.value)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), DIMENSIONS + 1).cast(pa.list_(pa.float32()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": rows, "y": batch.column("y")})

    usable = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("double").alias("y"))
    usable = usable.filter(~held_out(F.col("doc_id")) & F.col("y").isin(0.0, 1.0))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "y").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")  # train_rows rows of two numbers
    # Documents repeated under one id are learned from once each, within the same bound.
    found = rows.mapInArrow(run, "doc_id bigint, x array<float>, y double").orderBy("doc_id", "y", "x").limit(train_rows)
    found = found.toArrow()
    x = np.array(found["x"].to_pylist(), np.float32).reshape(-1, DIMENSIONS + 1)
    return fit(x, found["y"].to_numpy())


def _fitted(docs: DataFrame, labels: DataFrame, train_rows: int):
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # a table of fixed size
    return vectors, context.broadcast(train(docs, labels, vectors, train_rows))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``)."""
    vectors, model = _fitted(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(pooled(batch.column("text"), vectors.value))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scored = narrow.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``KEEP_FROM`` or more."""
    vectors, model = _fitted(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(pooled(batch.column("text"), vectors.value))
            yield batch.filter(pa.array(scores >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)
