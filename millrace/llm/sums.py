"""Tables of counts of a fixed size, summed over all rows of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 13  # numbers that travel together
_KINDS = "block int, sums binary"


def _batch(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({
        "block": pa.array(list(blocks), pa.int32()),
        "sums": pa.array([b.astype("<i8").tobytes() for b in blocks.values()], pa.binary()),
    })


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(data, "<i8")
    yield _batch(sums)


def summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over ``rows`` of what ``add`` adds to a table of ``size`` whole numbers.

    Each task fills one table and passes on its blocks that are not all zero; those of one place
    are added up in one task, a row at a time. What comes here is the table.
    """
    padded = -(-size // BLOCK) * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(padded, np.int64)
        for batch in batches:
            add(table, batch)
        blocks = table.reshape(-1, BLOCK)
        yield _batch({int(k): blocks[k] for k in np.flatnonzero(blocks.any(axis=1))})

    out = np.zeros((padded // BLOCK, BLOCK), np.int64)
    for row in rows.mapInArrow(run, _KINDS).repartition("block").mapInArrow(_add, _KINDS).collect():
        out[row.block] = np.frombuffer(row.sums, "<i8")
    return out.reshape(-1)[:size]
