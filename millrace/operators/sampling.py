"""TABLESAMPLE in its four forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workdir import materialise

_SEQ = "__seq"
FEW_ROWS = 10_000  # rows that one task is asked to take from each partition
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def percent(df: DataFrame, share: float, seed: int | None = None) -> DataFrame:
    """``TABLESAMPLE (share PERCENT)``: each row kept with that probability."""
    if not 0 <= share <= 100:
        raise ValueError("sampling percentage must be between 0 and 100")
    return df.sample(share / 100.0, seed)


def percent_by(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """``share`` percent of the keys, with all rows of each: by the key's digest, so the same on any cluster."""
    if not 0 <= share <= 100:
        raise ValueError("sampling percentage must be between 0 and 100")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.filter(place < round(share / 100 * 2**32))


def rows(df: DataFrame, n: int, order: Sequence[Column], few: int = FEW_ROWS) -> DataFrame:
    """``TABLESAMPLE (n ROWS)``, the first ``n`` by a total order: repeatable.

    Spark's limit brings the first ``n`` rows of every partition to one task, which serves for few. More rows are
    sorted by range and written; the pieces' counts, one number each, tell which are whole in the sample and how many
    rows of the one at its end are.
    """
    if n < 0:
        raise ValueError("number of rows must not be negative")
    if n <= few:
        return df.orderBy(*order).limit(n)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(sorted_.withColumn(_SEQ, F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright(_SEQ, 33)  # the id counts on from here in each piece
    counts = placed.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).orderBy("piece").collect()
    for part in counts:
        if n < part["n"]:
            return placed.filter(F.col(_SEQ) < (part["piece"] << 33) + n).drop(_SEQ)
        n -= part["n"]
    return placed.drop(_SEQ)


def bucket(
    df: DataFrame, x: int, y: int, on: str | Column | None = None, seed: int | None = None
) -> DataFrame:
    """``TABLESAMPLE (BUCKET x OUT OF y [ON column or expression])``.

    Integer columns are bucketed by value, others by hash. Without a column there
    are no buckets: Spark has always read that form as a random ``x / y`` of the rows.
    """
    if not 1 <= x <= y:
        raise ValueError("need 1 <= x <= y")
    if on is None:
        return df.sample(x / y, seed)
    value = F.col(on) if isinstance(on, str) else on
    integer = isinstance(df.select(value).schema[0].dataType, _INTEGERS)
    number = value if integer else F.hash(value)
    return df.filter(F.pmod(number, F.lit(y)) == x - 1)


def size_in_bytes(text: str) -> int:
    """``'100M'`` -> 104857600; the unit is one of B, K, M, G (1024 steps)."""
    units = {"B": 0, "K": 1, "M": 2, "G": 3}
    number, unit = text[:-1], text[-1:].upper()
    if unit not in units or not number.isdigit():
        raise ValueError(f"not a byte size: {text!r}")
    return int(number) * 1024 ** units[unit]


def first_bytes(df: DataFrame, budget: int | str, size: Column, order: str) -> DataFrame:
    """``TABLESAMPLE (100M)``: the longest prefix by ``order`` within a byte budget.

    ``order`` is an integer column; nulls in it, which have no place in the order,
    are refused. Rows that share a value stay together. ``size`` is added up over 256 slices of a span of values at the low
    end; while the budget lasts, the next span is four times as long, so no more than a few budgets of
    rows are ever read. Inside the slice in which the budget runs out the search is repeated: a handful
    of aggregations over small parts, no sort, 256 sums at most per pass, each behind a filter the scan can push down,
    as is the sample itself.
    """
    if isinstance(budget, str):
        budget = size_in_bytes(budget)
    low, last, nulls = df.agg(F.min(order), F.max(order), F.count_if(F.col(order).isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} rows without {order}")
    if low is None:
        return df
    spent, span = 0, max(256, (last - low) >> 16)
    while low <= last:
        high = min(last, low + span - 1)
        step = -(-(high - low + 1) // 256)
        slices = (
            df.filter(F.col(order).between(low, high))
            .groupBy(F.expr(f"(`{order}` - {low}L) div {step}L").alias("slice"))
            .agg(F.sum(size).alias("bytes"))
            .orderBy("slice")
            .collect()
        )
        for part in slices:
            if spent + part["bytes"] > budget:
                break
            spent += part["bytes"]
        else:
            low, span = high + 1, 4 * span
            continue
        low += part["slice"] * step
        if step == 1:
            break
        last = min(high, low + step - 1)
        span = step
    return df.filter(F.col(order) < low)
