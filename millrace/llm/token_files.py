"""Operator 1: token ids of documents in bit-packed shard files.

``write_tokens`` deals the documents out by ranges of ``doc_id``, so shard after shard and
image after image hold the documents in ascending order. Each row of the written table is
one file image (``bitpack``) with the ids of whole documents, and an index of them: document
``j`` of an image begins at the sum of the ``n_tokens`` before it. Spark's writer commits the
files, so a lost executor or a second attempt leaves neither gaps nor doubles, and any store
Spark can write to will do.

Nulls: a null text is empty and gets the end id alone; null ids come first. Repeated rows
are kept, those of one ``doc_id`` ordered by the XXH64 (seed 42, signed) of their text; rows alike in both may be
in several shards, so no id is one task's work. Empty tables give no image. Columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import workdir
from millrace.llm import bitpack
from millrace.llm.encoding import default_vocabulary, encoder as encoder_of, load
from millrace.llm.frames import list_column

IMAGES = (
    "shard int, image int, bits int, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, data binary"
)
_IMAGES = pa.schema([
    ("shard", pa.int32()), ("image", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary()),
])
IMAGE_IDS = 1 << 19  # ids after which an image ends, at the end of a document


def with_end(ids: np.ndarray, n_ids: np.ndarray, end_id: int) -> np.ndarray:
    """All ids with ``end_id`` after each document's."""
    return np.insert(ids, np.cumsum(n_ids), end_id)


def _encode(vocabulary: str, end_id: int, bits: int, remembered: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(vocabulary, remembered=remembered), TaskContext.get().partitionId()
        image, docs, counts, parts, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            n = np.concatenate(counts)
            return pa.record_batch([
                pa.array([shard], pa.int32()), pa.array([image], pa.int32()), pa.array([bits], pa.int32()),
                pa.array([len(ids)], pa.int64()), pa.array([[d for x in docs for d in x]], pa.list_(pa.int64())),
                list_column(n, np.array([len(n)]), pa.int64()),
                pa.array([bitpack.image(ids, bits)], pa.binary()),
            ], schema=_IMAGES)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, n = encoder(texts)
            parts.append(with_end(ids, n, end_id))
            counts.append(n + 1)
            docs.append(batch.column("doc_id").to_pylist())
            held += len(parts[-1])
            if held >= IMAGE_IDS:
                yield flush()
                image, docs, counts, parts, held = image + 1, [], [], [], 0
        if parts:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 2, remembered: int | None = None
) -> DataFrame:
    """Encode ``doc_id, text`` and write the images; the written table, see the module.

    ``remembered`` bounds the pieces of texts whose ids a worker remembers, and so its memory, at the cost of time.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or workdir.fresh_path(spark, "tokens")
    bits = bitpack.bits_for(max(load(vocabulary).get_vocab_size(), end_id + 1))
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .withColumns({"tie": F.xxhash64("text"), "dealt": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "tie", "dealt")
        .sortWithinPartitions("doc_id", "tie", "dealt")
        .select("doc_id", "text")
    )
    # Packed ids do not compress, so nothing is spent on trying.
    ordered.mapInArrow(_encode(vocabulary, end_id, bits, remembered), IMAGES).write.option("compression", "none").parquet(path)
    return read_tokens(spark, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMAGES).parquet(path)


_SUMS = "shard int, image int, pos int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            n = batch.column("n_tokens")[row].values.to_numpy()
            ends = np.cumsum(n)
            image = bitpack.Image(batch.column("data")[row].as_buffer())
            ids = memoryview(image.read(0, image.n_ids).astype("<u4")).cast("B")
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends - n, ends, strict=True)]
            size = len(n)
            yield pa.record_batch({
                "shard": pa.array(np.full(size, batch.column("shard")[row].as_py(), np.int32)),
                "image": pa.array(np.full(size, batch.column("image")[row].as_py(), np.int32)),
                "pos": pa.array(np.arange(size, dtype=np.int32)),
                "doc_id": batch.column("doc_ids")[row].values, "local": pa.array(ends - n),
                "n_tokens": pa.array(n), "ids_crc32": pa.array(crcs, pa.int64()),
            })


def document_index(images: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, all worked out from the images read back.

    Where an image starts is a running sum over one row per image (half a million ids
    each), summed per shard first.
    """
    sizes = images.select("shard", "image", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    shards = shards.select("shard", (F.sum("all_ids").over(Window.orderBy("shard")) - F.col("all_ids")).alias("base"))
    within = Window.partitionBy("shard").orderBy("image")
    bases = sizes.select("shard", "image", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("offset"))
    bases = bases.join(shards, "shard").select("shard", "image", (F.col("base") + F.col("offset")).alias("base"))
    found = images.select("shard", "image", "doc_ids", "n_tokens", "data").mapInArrow(_summaries, _SUMS)
    return found.join(bases, ["shard", "image"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
