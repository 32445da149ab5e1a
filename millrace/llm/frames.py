"""What the operators share: session settings, batches, written stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import workdir
from millrace.operators.skew import broadcast_if_small
from millrace.session import tune

# A batch sent to Python holds at most so many rows and about so many bytes, so a
# worker's memory is set by its batch (or by one very long text), not by its partition.
BATCH_ROWS = 2000
BATCH_BYTES = 8 * 1024 * 1024


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    return workdir.materialise(df, label)


def fresh(name: str) -> str:
    """A column name no input has, for work columns next to a caller's own."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def numbered(rows: DataFrame, part: str, order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``rows`` with their ``rank`` (from 0, by ``order``) among those of their ``part``, and the part's ``size``.

    Rows are sorted by range, and a row's rank is its place in its piece and the rows of its part in earlier
    pieces, so no part is in one task. Rows alike in ``part`` and ``order`` are numbered in any order. ``part`` is not null.
    """
    dealt, place, piece, first, n, shift = (fresh(c) for c in ("dealt", "place", "piece", "first", "n", "shift"))
    spread = rows.withColumn(dealt, F.monotonically_increasing_id())  # so that equal rows can be in several pieces
    pieces = spread.repartitionByRange(part, *order, dealt).sortWithinPartitions(part, *order, dealt)
    placed = written(pieces.drop(dealt).withColumn(place, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(piece, F.shiftright(place, 33))
    counts = placed.groupBy(part, piece).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(first))
    own = Window.partitionBy(part)  # a part has a row for each of its pieces
    before = F.sum(n).over(own.orderBy(piece)) - F.col(n)
    totals = counts.select(part, piece, (before - F.col(first)).alias(shift), F.sum(n).over(own).alias(size))
    joined = placed.join(broadcast_if_small(written(totals, "totals")), [part, piece])
    return joined.withColumn(rank, F.col(place) + F.col(shift)).drop(piece, place, shift)


def flat_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow text column and each text's first byte (n + 1 offsets); null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length`` of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
