"""Operator 12: rules on words, lines and symbols, and a log-likelihood ratio of hashed n-grams.

Base figures count over the words of a text (what stands between ASCII white space) and its lines. A text
with fewer than 50 words, or with more than half of its words in repeated windows of three words, fails.

The method's verdict compares two multinomials over hashed n-grams: one of trusted texts, those that ``labels`` marks
with quality 1, one of the whole corpus. A text is cut into units (runs of letters, digits and anything outside
ASCII, lower-cased, and runs of ASCII marks); its n-grams are the units and the pairs of neighbouring units, hashed into
``2 ** BITS`` buckets. Every task counts both in one table of fixed size, and the tables are added up. The trusted
distribution is smoothed by ``PRIOR`` n-grams of the corpus, so few trusted texts give ratios near zero. A text's
``score`` is the mean over its n-grams of the logarithm of trusted over corpus probability, in whole millionths, so
that sums are exact and every run decides alike; it is kept when its score is ``KEEP_FROM`` or more.

Null and empty texts have no words, score 0 and fail by length. Null ids are judged and never trusted;
null labels mark nothing; repeated rows are counted and judged each, and repeated labels mark once. Without trusted
texts every score is 0. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.frames import flat_texts, slices
from millrace.llm.sums import summed
from millrace.operators.skew import broadcast_if_small

BITS = 16
PRIOR = 1 << 18
KEEP_FROM = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_KIND = np.where(words.WORD_BYTES, 1, np.where(words.INK_BYTES, 2, 0)).astype(np.int8)


def ngrams(column, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, and the text (counted from it) and bucket of every n-gram, about a megabyte of texts at a time."""
    data, offsets = flat_texts(column)
    for first, last in slices(offsets, words.SLICE_BYTES):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        kind = _KIND[part]
        change = np.ones(len(part) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[own] = True
        edges = np.flatnonzero(change)
        if len(edges) < 2:
            continue
        ink = kind[edges[:-1]] > 0
        starts, ends = edges[:-1][ink], edges[1:][ink]
        units = words.hashed(part, starts, ends)
        text = np.searchsorted(own, starts, side="right") - 1
        pairs, same = words.pairs(units, 1), text[1:] == text[:-1]
        buckets = np.concatenate((units, pairs[same])) >> np.uint64(64 - bits)
        yield first, np.concatenate((text, text[1:][same])), buckets.astype(np.int64)


def ratios(docs: DataFrame, labels: DataFrame, bits: int = BITS, prior: int = PRIOR) -> np.ndarray:
    """The logarithm of trusted over corpus probability of every bucket, in millionths, from all texts."""
    size = 1 << bits
    marked = labels.filter("quality = 1 AND doc_id IS NOT NULL")
    trusted = marked.select(F.col("doc_id").cast("bigint"), F.lit(True).alias("trusted")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = texts.join(broadcast_if_small(trusted), "doc_id", "left").select("text", F.col("trusted").isNotNull().alias("trusted"))

    def add(table: np.ndarray, batch: pa.RecordBatch) -> None:
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
        for first, text, bucket in ngrams(batch.column("text"), bits):
            table[:size] += np.bincount(bucket, minlength=size)
            table[size:] += np.bincount(bucket[trusted[first + text]], minlength=size)

    raw, target = summed(rows, 2 * size, add).reshape(2, size).astype(np.float64)
    corpus = (raw + 1) / (raw.sum() + size)
    return np.rint(1e6 * np.log((target + prior * corpus) / (target.sum() + prior) / corpus)).astype(np.int64)


def likelihoods(column, table: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the sum of its n-grams' ratios, in millionths, and their number."""
    sums, counts = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for first, text, bucket in ngrams(column, bits):
        np.add.at(sums, first + text, table[bucket])
        np.add.at(counts, first + text, 1)
    return sums, counts


def base_figures(texts: list[bytes]) -> np.ndarray:
    """A row for each text: words, code points in words, symbols, duplicate lines, words in repeated windows."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0] = n
    out[:, 4] = repeated(words.symbols(split), n)
    for k, text in enumerate(texts):
        ink = text.translate(None, _SPACE)
        out[k, 1] = len(ink.decode("utf-8", "replace"))
        out[k, 2] = len(ink) - len(ink.translate(None, SYMBOLS))
        lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
        out[k, 3] = len(lines) - len(set(lines))
    return out


def repeated(symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words of each text in a window of ``WINDOW`` words that the text holds twice or more."""
    total = len(symbol)
    if total < WINDOW:
        return np.zeros(len(n), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    # Windows are numbered word by word, so equal numbers are equal words.
    window = symbol[: total - WINDOW + 1]
    for k in range(1, WINDOW):
        _, window = np.unique(window * np.int64(total) + symbol[k : total - WINDOW + 1 + k], return_inverse=True)
    whole = text[WINDOW - 1 :] == text[: total - WINDOW + 1]  # words of two texts never make a window
    twice = whole & (np.bincount(window[whole], minlength=int(window.max()) + 1) > 1)[window]
    inside = np.zeros(total, bool)
    for k in range(WINDOW):
        inside[k : total - WINDOW + 1 + k] |= twice
    return np.bincount(text[inside], minlength=len(n))


_JUDGED = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_grams bigint, ratio_sum bigint"
)


def judged(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Base figures, ``base_failed``, ``score`` and ``kept`` of every row of ``docs`` (``doc_id``, ``text``).

    ``labels``: ``doc_id``, and ``quality`` 1 for trusted texts.
    """
    table = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            figures = np.concatenate([np.zeros((0, 5), np.int64), *map(base_figures, words.groups(texts))])
            sums, counts = likelihoods(batch.column("text"), table.value)
            columns = [batch.column("doc_id"), *map(pa.array, figures.T.copy()), pa.array(counts), pa.array(sums)]
            yield pa.record_batch(columns, names=[c.split()[0] for c in _JUDGED.split(", ")])

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _JUDGED)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    least = F.lit(round(keep_from * 1e6)).cast("bigint")
    passed = F.col("ratio_sum") >= least * F.col("n_grams")
    score = F.when(F.col("n_grams") > 0, F.col("ratio_sum") / F.col("n_grams") / 1e6).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"), score.alias("score"),
    )
