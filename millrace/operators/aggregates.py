"""Aggregates that need an order, and exact distinct counts that can be merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(value: Column, order: Sequence[Column], ignore_nulls: bool) -> tuple[Column, Column]:
    # The value travels in a struct so that a null value can win; the order key is
    # nulled where the row must not count.
    key = F.struct(*order)
    if ignore_nulls:
        key = F.when(value.isNotNull(), key)
    return F.struct(value.alias("v")), key


def first(value: Column, order: Sequence[Column], ignore_nulls: bool = False) -> Column:
    """``FIRST(value [IGNORE NULLS])`` by an explicit order, combined map-side."""
    boxed, key = _ordered(value, order, ignore_nulls)
    return F.min_by(boxed, key)["v"]


def last(value: Column, order: Sequence[Column], ignore_nulls: bool = False) -> Column:
    """``LAST(value [IGNORE NULLS])`` by an explicit order, combined map-side."""
    boxed, key = _ordered(value, order, ignore_nulls)
    return F.max_by(boxed, key)["v"]


def distinct_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, counted, word, bits``: which values the integer ``columns`` have in each group.

    ``counted`` is the column's place and ``bits`` a bitmap of the 64 values of a ``word``; a null has a word of its own without
    bits, so that its group is there. Each column is one scan of the keys and itself, combined in the tasks that read: rows
    are not multiplied by the number of columns. Kept in a table, states of new rows can be added to it by union.
    """

    def states(place: int, column: str) -> DataFrame:
        value = F.col(column).cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), value.bitwiseAND(63).cast("int"))
        rows = df.select(*keys, F.lit(place).alias("counted"), F.shiftright(value, 6).alias("word"), bit.alias("bits"))
        return rows.groupBy(*keys, "counted", "word").agg(F.bit_or("bits").alias("bits"))

    return reduce(DataFrame.unionByName, [states(i, c) for i, c in enumerate(columns)])


def distinct_counts(states: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Distinct counts per group of ``keys``, all or some of the states' own, under one of ``names`` for each column."""
    merged = states.groupBy(*keys, "counted", "word").agg(F.bit_or("bits").alias("bits"))
    ones = F.coalesce(F.bit_count("bits").cast("bigint"), F.lit(0).cast("bigint"))
    counts = [F.sum(F.when(F.col("counted") == i, ones).otherwise(0)).alias(n) for i, n in enumerate(names)]
    return merged.groupBy(*keys).agg(*counts)
