"""Operator 8: documents that hold exact, edited or paraphrased copies of test items.

1. Words (runs of ASCII letters and digits and of anything outside ASCII, A-Z lower-cased) are
   hashed, and every two words of a test item that stand next to each other or one word apart become a
   gram. An alignment of ``s`` points has at least ``s / 2 - 1`` pairs of consecutive matched words
   with at most one edit between them (the edits cost a point each, so there are fewer of them than
   twice the matches), and both words of such a pair stand one or two words apart in the item
   and in the document. Items so short that this promises no pair use single words.
2. Seeds: of so many places that must be matched, half are asked for: so many places of each item are taken that any
   alignment has them among its own, those with the rarest grams in the corpus first. Each
   alignment from ``threshold`` on has that many seeds, whatever the counts are; they only order the work.
   The counts come from one pass over the documents, for which a bitmap of the grams, of bounded
   size, is sent to the tasks and lets most places go.
3. A second pass, with bitmaps of the seeds, gathers a document's places into segments, with as many
   words around them as an alignment can reach. Items go in layers by their reach, to a power of two, each with
   segments of its own, so a very long item widens no other's. An equal-join with the seeds counts the places that
   segment and item share; pairs with as many as asked for are candidates.
4. Smith-Waterman aligns each candidate segment that holds enough of its item's words with the item, word by
   word (match 2, else -1).
   The score is the best alignment as a share of the item's own, and a pair counts from ``threshold``.

Null and empty texts and items without words match nothing. Repeated documents or items (by id)
are worked on as they are, and a pair has its best score. Other columns are not read. Empty tables
on either side give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.frames import list_column, ragged, written
from millrace.operators.skew import broadcast_if_small

THRESHOLD = 0.5
# The bitmap has two to the power of so many bits: enough for 256 a gram, 2 to 128 MB.
LEAST_BITS, MOST_BITS = 24, 30
MATCH, OTHER = 2, -1



def _numbered() -> int:
    """The first of this task's numbers; no other task of the same job has one of them."""
    return TaskContext.get().partitionId() << 33


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = _numbered()
    for batch in batches:
        for w in words.scan(batch.column("text")):
            yield pa.record_batch({
                "item": pa.array(number + np.arange(len(w.counts))),
                "item_id": batch.column("item_id").slice(w.first, len(w.counts)),
                "words": list_column(w.hashes.view(np.int64), w.counts, pa.int64()),
            })
            number += len(w.counts)


def item_words(items: DataFrame) -> DataFrame:
    """``item, item_id, words``: a number for each test item that has words, its id and its hashed words."""
    narrow = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    found = narrow.mapInArrow(_item_words, "item bigint, item_id bigint, words array<bigint>")
    return written(found.filter("size(words) > 0"), "items")


def least_score(size: int, threshold: float) -> int:
    """The smallest score of an alignment with an item of ``size`` words that counts."""
    return max(1, math.ceil(MATCH * size * threshold - 1e-9))


def layer(size: int, threshold: float) -> int:
    """The power of two that the reach of an item of ``size`` words stays below.

    Of an alignment, every word of the document is matched or an edit.
    """
    return ((1 + MATCH) * size - least_score(size, threshold)).bit_length()


def _found(hashes: np.ndarray, step: int) -> np.ndarray:
    """The gram at each word: of the word and the one ``step`` words on, or of the word alone."""
    return words.pairs(hashes, step) if step else hashes


def _grams(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("words")[row].values.to_numpy().view(np.uint64)
                sure = -(-least_score(len(own), threshold) // 2) - 1  # places that are matched at least
                steps = (1, 2) if sure > 0 else (0,)
                need = max(1, (sure + 1) // 2)
                cover = min(len(own), len(own) - max(0, sure) + need - 1) if sure > 0 else len(own)
                grams = [_found(own, step) for step in steps]
                sizes = [len(g) for g in grams]
                yield pa.record_batch({
                    "item": pa.array([batch.column("item")[row].as_py()] * sum(sizes), pa.int64()),
                    "at": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    "step": pa.array(np.repeat(np.array(steps, np.int32), sizes)),
                    "cover": pa.array(np.full(sum(sizes), cover, np.int32)),
                    "need": pa.array(np.full(sum(sizes), need, np.int32)),
                    "layer": pa.array(np.full(sum(sizes), layer(len(own), threshold), np.int32)),
                    "gram": pa.array(np.concatenate(grams).view(np.int64)),
                })

    return run


def gram_bitmap(grams: DataFrame, least: int = LEAST_BITS, most: int = MOST_BITS) -> np.ndarray:
    """One bit for the leading bits of every gram, in bytes; its size is bounded by ``most``.

    The tasks fill blocks of 4 KB; only finished blocks come here.
    """
    size = min(most, max(least, (256 * grams.count()).bit_length()))
    place = grams.select((F.shiftrightunsigned("gram", 64 - size) + 1).alias("place"))
    blocks = place.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    bits = np.zeros((max(1, (1 << size) >> 15), 1 << 12), np.uint8)
    for row in blocks.collect():
        bits[row["block"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def _known(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the grams whose bit is set."""
    place = grams >> np.uint64(64 - (8 * len(bits) - 1).bit_length())
    return np.flatnonzero((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)


_PLACES = (
    "layer int, doc_id bigint, segment bigint, starts bigint, words array<bigint>, grams array<bigint>, at array<int>"
)


def _standing(bits: np.ndarray, w: words.Words, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the grams of whole texts that the bitmap knows."""
    ends = np.cumsum(w.counts)
    found, values = [], []
    for step in steps:
        grams = _found(w.hashes, step)
        at = _known(bits, grams)
        at = at[at + step < ends[np.searchsorted(ends, at, side="right")]]  # within one text
        found.append(at)
        values.append(grams[at])
    return np.concatenate(found), np.concatenate(values)


def _tally(bitmap, steps: list[int]):
    """How often each known gram stands in the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words.scan(batch.column("text")):
                grams, n = np.unique(_standing(bitmap.value, w, steps)[1], return_counts=True)
                yield pa.record_batch({"gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def _places(layers, steps: list[int]):
    """Segments of documents around the words at which seeds may stand, for every layer of items.

    ``layers``: each one's bitmap and the number of places without which no item of it has what it needs.
    """

    def segments(batch: pa.RecordBatch, w: words.Words, number: int, segment: int) -> pa.RecordBatch | None:
        reach, ends = 1 << number, np.cumsum(w.counts)
        bits, least = layers.value[number]
        at, gram = _standing(bits, w, steps)
        if not len(at):
            return None
        order = np.argsort(at, kind="stable")
        at, gram = at[order], gram[order]
        text = np.searchsorted(ends, at, side="right")
        new = np.concatenate(([True], (np.diff(at) > reach) | (np.diff(text) > 0)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        enough = last - first + 1 >= least
        kept = np.repeat(enough, last - first + 1)
        first, last, at, gram = first[enough], last[enough], at[kept], gram[kept]
        if not len(first):
            return None
        text = text[kept]
        last = np.cumsum(last - first + 1) - 1
        first = np.concatenate(([0], last[:-1] + 1))
        base = (ends - w.counts)[text[first]]
        begins = np.maximum(at[first] - reach, base)
        stops = np.minimum(at[last] + 1 + reach, ends[text[first]])
        return pa.record_batch({
            "layer": pa.array(np.full(len(first), number, np.int32)),
            "doc_id": batch.column("doc_id").take(pa.array(w.first + text[first])),
            "segment": pa.array(segment + np.arange(len(first))),
            "starts": pa.array(begins - base),
            "words": list_column(w.hashes[ragged(begins, stops - begins)].view(np.int64), stops - begins, pa.int64()),
            "grams": list_column(gram.view(np.int64), last - first + 1, pa.int64()),
            "at": list_column((at - np.repeat(begins, last - first + 1)).astype(np.int32), last - first + 1, pa.int32()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _numbered()
        for batch in batches:
            for w in words.scan(batch.column("text")):
                for number in layers.value:
                    made = segments(batch, w, number, segment)
                    if made is not None:
                        yield made
                        segment += made.num_rows

    return run


def align(segment: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score and where in the segment it ends.

    A gap in the segment's direction is a running maximum, so each word of the item is a few numpy steps.
    """
    slope = np.arange(len(segment) + 1) * -OTHER
    row = np.zeros(len(segment) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        fresh = np.maximum(row + OTHER, 0)
        np.maximum(fresh[1:], row[:-1] + np.where(segment == word, MATCH, OTHER), out=fresh[1:])
        row = np.maximum.accumulate(fresh + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _align(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, ends, known = [], [], {}
            segments, items = batch.column("words"), batch.column("item_words")
            for row in range(batch.num_rows):
                segment, item = segments[row].values.to_numpy(), items[row].values.to_numpy()
                key = (segment.tobytes(), item.tobytes())  # copies of a passage are aligned once a batch
                if key not in known:
                    # An alignment of so many points matches half as many words of the item.
                    enough = MATCH * np.isin(item, segment).sum() >= least_score(len(item), threshold)
                    known[key] = align(segment, item) if enough else (0, 0)
                best, end = known[key]
                scores.append(best / (MATCH * len(item)))
                ends.append(end)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "item_id": batch.column("item_id"),
                "score": pa.array(scores, pa.float64()),
                "ends": pa.array(np.array(ends, np.int64) + batch.column("starts").to_numpy()),
            })

    return run


def seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``gram, item, at, step, need, layer``: the grams of the ``cover`` places of each item that are rarest, ties to the first.

    ``counts`` has how often each gram stands in the corpus.
    """
    counted = grams.join(counts, "gram", "left")
    places = counted.groupBy("item", "at", "cover").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "at"))
    taken = places.withColumn("rank", rank).filter("rank <= cover").select("item", "at")
    return grams.join(taken, ["item", "at"]).select("gram", "item", "at", "step", "need", "layer")


def _steps(grams: DataFrame) -> list[int]:
    return sorted(r[0] for r in grams.select("step").distinct().collect()) or [1]  # three at most


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, ends``: documents (``doc_id``, ``text``) that hold a copy of an item
    (``item_id``, ``text``), the best score, and the word after the best alignment."""
    spark = docs.sparkSession
    own = item_words(items)
    kinds = "item bigint, at int, step int, cover int, need int, layer int, gram bigint"
    grams = written(own.mapInArrow(_grams(threshold), kinds), "grams")
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    bitmap = spark.sparkContext.broadcast(gram_bitmap(grams))
    tally = narrow.select("text").mapInArrow(_tally(bitmap, _steps(grams)), "gram bigint, n bigint")
    rare = written(seeds(grams, tally.groupBy("gram").agg(F.sum("n").alias("n"))), "seeds")
    # A layer has items of more than half its reach: as many as powers of two, whatever the items.
    alike = rare.groupBy("layer", "item", "gram").agg(F.count_distinct("at").alias("n"), F.first("need").alias("need"))
    found = alike.groupBy("layer").agg(F.min("need").alias("need"), F.max("n").alias("n")).collect()
    least = {r["layer"]: -(-r["need"] // r["n"]) for r in found}  # a gram stands at so many places of an item at most
    bitmaps = {n: (gram_bitmap(rare.filter(F.col("layer") == n)), least[n]) for n in sorted(least)}
    layers = spark.sparkContext.broadcast(bitmaps)
    segments = written(narrow.mapInArrow(_places(layers, _steps(rare)), _PLACES), "segments")

    found = segments.select("layer", "segment", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = found.join(rare, ["layer", "gram"]).groupBy("segment", "item").agg(
        F.count_distinct("at").alias("places"), F.first("need").alias("need")
    )
    pairs = written(shared.filter("places >= need").select("segment", "item"), "pairs")
    joined = segments.select("doc_id", "segment", "starts", "words").join(broadcast_if_small(pairs), "segment")
    joined = joined.join(own.select("item", "item_id", F.col("words").alias("item_words")), "item")
    scored = joined.select("doc_id", "item_id", "starts", "words", "item_words").mapInArrow(
        _align(threshold), "doc_id bigint, item_id bigint, score double, ends bigint"
    )
    best = F.max(F.struct("score", "ends")).alias("best")
    return (
        scored.filter(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(best)
        .select("doc_id", "item_id", "best.score", "best.ends")
    )


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id, n_items, score``: each document with a copy, how many items it copies, and its best score."""
    found = matches(docs, items, **how)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("score").alias("score"))
