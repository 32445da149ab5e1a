"""Set operations on whole rows, duplicates removed before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import skew


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """``INTERSECT``: both sides shrink to distinct rows map-side first, so a row
    that makes up most of a table does not travel."""
    return left.distinct().intersect(right.distinct())


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    """``EXCEPT`` / ``MINUS``, likewise on distinct rows."""
    return left.distinct().subtract(right.distinct())


def intersect_all(left: DataFrame, right: DataFrame, limit: int = skew.TASK_ROWS) -> DataFrame:
    """``INTERSECT ALL``: every row as often as both sides have it."""
    if _within(left, limit) or _within(right, limit):
        return left.intersectAll(right)
    return _repeat(left, _counted(left, right), F.least("__left", "__right"), limit)


def except_all(left: DataFrame, right: DataFrame, limit: int = skew.TASK_ROWS) -> DataFrame:
    """``EXCEPT ALL``: every row as often as ``left`` has it more than ``right``."""
    if _within(left, limit):
        return left.exceptAll(right)
    return _repeat(left, _counted(left, right), F.col("__left") - F.col("__right"), limit)


def _within(side: DataFrame, limit: int) -> bool:
    """Whether no row can have more than ``limit`` copies: by file footers, or by counting where they do not tell."""
    most = skew.most_rows(side)
    return most <= limit if most is not None else not skew.group_sizes(side, side.columns, limit).any_hot


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both sides with how often each side has them."""
    tagged = left.withColumn("__side", F.lit(1)).unionAll(
        right.toDF(*left.columns).withColumn("__side", F.lit(0))
    )
    return tagged.groupBy(*left.columns).agg(
        F.sum("__side").alias("__left"), F.sum(1 - F.col("__side")).alias("__right")
    )


def _repeat(left: DataFrame, counted: DataFrame, times: Column, limit: int) -> DataFrame:
    """Each row ``times`` over.

    Spark's own plan emits all copies of a row from one task, which serves while a
    whole side is within ``limit``. Here one task emits ``limit`` of them at most;
    what goes beyond, for rows that have so many copies, is dealt out to other tasks
    in portions.
    """
    wanted = counted.select(*left.columns, times.alias("__n")).filter(F.col("__n") > 0)
    portion = F.least(F.lit(limit), F.col("__n") - F.col("__portion") * limit).cast("int")
    first = wanted.withColumn("__portion", F.lit(0).cast("long"))
    others = (
        wanted.filter(F.col("__n") > limit)
        .withColumn("__portion", F.explode(F.expr(f"sequence(1L, (__n - 1) div {limit})")))
        .repartition(*left.columns, "__portion")
    )
    return (
        first.unionAll(others)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), portion)))
        .select(*left.columns)
    )


class Chain:
    """A chain of set operations of equal precedence, applied left to right.

    SQL text binds INTERSECT tighter than the others; a chain does not:
    ``Chain(a).union(b).intersect(c)`` is ``(a UNION b) INTERSECT c``.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def union(self, other: DataFrame) -> Chain:
        return Chain(union_distinct(self.df, other))

    def union_all(self, other: DataFrame) -> Chain:
        return Chain(self.df.union(other))

    def intersect(self, other: DataFrame) -> Chain:
        return Chain(intersect(self.df, other))

    def intersect_all(self, other: DataFrame) -> Chain:
        return Chain(intersect_all(self.df, other))

    def except_(self, other: DataFrame) -> Chain:
        return Chain(except_(self.df, other))

    def except_all(self, other: DataFrame) -> Chain:
        return Chain(except_all(self.df, other))
