"""Vectorised user-defined functions: scalar, aggregate and table forms."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Executors need not have this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOWELS = np.isin(np.arange(256), list(b"aeiouAEIOU"))
VOWEL_BYTES = 1 << 20


@F.arrow_udf(T.LongType())
def vowel_count(text: pa.Array) -> pa.Array:
    """Number of unaccented Latin vowels in each text.

    Works on the bytes of a batch, ``VOWEL_BYTES`` at a time whatever the batch holds or a text is long: these
    letters are single bytes in UTF-8 and never part of another character.
    """
    texts = text.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    upto = np.zeros(len(ends), np.int64)  # vowels before each text's first byte, and before the end
    before, first = 0, 0
    for start in range(int(ends[0]), int(ends[-1]), VOWEL_BYTES):
        counts = np.cumsum(_VOWELS[bytes_[start : min(start + VOWEL_BYTES, ends[-1])]], dtype=np.int32)
        last = int(np.searchsorted(ends, start + len(counts), side="right"))
        place = ends[first:last] - start  # from 0, where nothing of this piece is before a text
        upto[first:last] = before + np.where(place > 0, counts[place - 1], 0)
        before, first = before + int(counts[-1]), last
    return pa.array(np.diff(upto), pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))


@F.pandas_udf(T.DoubleType())
def with_tax(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
    """What a line costs after discount and tax."""
    return price * (1 - discount) * (1 + tax)


Script = Callable[[pa.Table], pa.Table]


def aggregate(
    df: DataFrame, keys: Sequence[str], script: Script, state: str, merge: Mapping[str, Column]
) -> DataFrame:
    """A user-defined aggregate, or ``SELECT REDUCE (…) USING script AS (…)``.

    ``script`` turns the rows of one Arrow batch into states: the ``keys`` and the
    columns ``state`` declares. Spark merges the states by the built-in aggregates of
    ``merge``. Only states are shuffled, a row for each key and batch at most, so a key
    with most of the rows is never gathered in one place.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield from script(pa.Table.from_batches([batch])).to_batches()

    fields = df.select(*keys).schema.simpleString()[len("struct<") : -1]
    states = df.mapInArrow(batches, f"{fields}, {state}")
    return states.groupBy(*keys).agg(*[column.alias(name) for name, column in merge.items()])


def geometric_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Geometric mean of the positive values per group; null without any."""

    def logs(rows: pa.Table) -> pa.Table:
        x = pc.cast(rows[value], pa.float64())
        rows = rows.set_column(rows.column_names.index(value), "x", pc.if_else(pc.greater(x, 0), x, None))
        rows = rows.append_column("log", pc.ln(rows["x"]))
        sums = rows.group_by(list(keys)).aggregate([("log", "sum"), ("log", "count")])
        return sums.select([*keys, "log_sum", "log_count"]).rename_columns([*keys, "logs", "n"])

    total, n = F.sum("logs"), F.sum("n")
    merge = {name: F.when(n > 0, F.exp(total / n))}
    return aggregate(df.select(*keys, value), keys, logs, "logs double, n bigint", merge)


def sum_and_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A REDUCE script: ``value`` added up and rows counted per key."""

    def script(rows: pa.Table) -> pa.Table:
        sums = rows.group_by(list(keys)).aggregate([(value, "sum"), ([], "count_all")])
        sums = sums.select([*keys, f"{value}_sum", "count_all"])
        sums = sums.set_column(len(keys), "part_sum", pc.cast(sums[f"{value}_sum"], pa.float64()))
        return sums.rename_columns([*keys, "part_sum", "part_rows"])

    merge = {"total": F.sum("part_sum"), "rows": F.sum("part_rows")}
    return aggregate(df.select(*keys, value), keys, script, "part_sum double, part_rows bigint", merge)


@F.arrow_udtf(returnType="key bigint, line_no int, line string")
class SplitLines:
    """Lines of the texts of a table argument (key, text), with their numbers from 0."""

    def eval(self, rows: pa.RecordBatch):
        lines = pc.split_pattern(rows.column(1), "\n")
        counts = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
        parents = pc.list_parent_indices(lines)
        numbers = np.arange(len(parents)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield pa.table({
            "key": rows.column(0).take(parents), "line_no": pa.array(numbers.astype(np.int32)),
            "line": pc.list_flatten(lines),
        })


def transform(df: DataFrame, script, schema: str) -> DataFrame:
    """``SELECT TRANSFORM (…) USING script AS (…)``.

    ``script`` maps an iterator of pandas batches to an iterator of pandas batches;
    no process is started on the executors.
    """
    return df.mapInPandas(script, schema)
