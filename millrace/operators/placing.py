"""DISTRIBUTE BY, SORT BY and CLUSTER BY."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from millrace.operators import skew


def distribute(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``DISTRIBUTE BY keys``: rows with equal keys go to the same partition, whatever the size of a group."""
    into = [] if partitions is None else [partitions]
    return df.repartition(*into, *keys)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    sizes: skew.GroupSizes | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Like ``distribute``, but for groups above the row limit, which no task need hold whole.

    The rows of such groups alone are spread with a salt, as many ways as their size
    asks for. For callers that place rows to balance work, such as writers.
    """
    sizes = sizes or skew.group_sizes(df, keys)
    into = [] if partitions is None else [partitions]
    if not sizes.any_hot:
        return df.repartition(*into, *keys)
    cold, hot = skew.split_hot(df, keys, sizes)
    return cold.repartition(*into, *keys).unionByName(
        skew.salted(hot, sizes).repartition(*into, *keys, skew.SALT).drop(skew.SALT)
    )


def sort_within(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``SORT BY``: order within each partition, no shuffle."""
    return df.sortWithinPartitions(*order)


def cluster(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``CLUSTER BY keys``: distribute and sort by the same columns."""
    return distribute(df, keys).sortWithinPartitions(*keys)
