"""Table and directory sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import placing

ROWS_PER_BUCKET = 8_000_000
MOST_BUCKETS = 65_536  # within spark.sql.sources.bucketing.maxBuckets
OPEN_FILES = 200  # of one task

PartitionSpec = Mapping[str, Any]  # column -> value, or None for "any value"


def bucket_count(rows: int, least: int = 8, most: int = MOST_BUCKETS) -> int:
    """Buckets for a table of so many rows: a power of two, so that tables of
    different sizes still have bucket counts that divide each other. Spark refuses
    more than 100000; beyond ``most`` the buckets grow instead of their number."""
    buckets = least
    while buckets * ROWS_PER_BUCKET < rows and 2 * buckets <= most:
        buckets *= 2
    return buckets


def create_table(
    df: DataFrame,
    name: str,
    path: str,
    partition_by: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
    sort_by: Sequence[str] = (),
    provider: str = "parquet",
) -> DataFrame:
    """``CREATE TABLE … USING provider PARTITIONED BY … CLUSTERED BY … LOCATION path AS``.

    Returns the table. Two tables bucketed alike on a key join on it without a
    shuffle. Rows are shuffled to their buckets first, so that a bucket is one
    sorted file; only a bucket with a hot key is written by several tasks.
    """
    if bucket_by:
        df = placing.spread(df, bucket_by, partitions=buckets)
    writer = df.write.format(provider).option("path", path).mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass(frozen=True)
class SkewedTable:
    """Rows at rest by ``SKEWED BY (column) ON (values) STORED AS DIRECTORIES``.

    Each listed value has a folder of its own, in as many files as its rows need, and all others share one, so a
    reader of some values opens their folders alone. ``folder`` holds the place of a value in the list, -1 for the rest.
    """

    rows: DataFrame  # the table's columns and its ``folder``
    column: str
    values: tuple
    folder: str

    def all(self) -> DataFrame:
        return self.rows.drop(self.folder)

    def among(self, values: Sequence[Any]) -> DataFrame:
        """Rows whose value is one of ``values``; None stands for null."""
        folders = {self.values.index(v) if v in self.values else -1 for v in values}
        tests = [F.col(self.column).eqNullSafe(F.lit(v)) for v in values]
        chosen = self.rows.filter(F.col(self.folder).isin(sorted(folders)))
        return chosen.filter(reduce(Column.__or__, tests, F.lit(False))).drop(self.folder)

    def rest(self) -> DataFrame:
        """Rows of the values that are not listed: what a join need not split."""
        return self.rows.filter(F.col(self.folder) == -1).drop(self.folder)


def create_skewed(df: DataFrame, path: str, column: str, values: Sequence[Any]) -> SkewedTable:
    """Write ``df`` with the listed ``values`` of ``column`` apart, None being null, and read it back."""
    folder = f"{column}_folder"
    while folder.lower() in {c.lower() for c in df.columns}:
        folder += "_"
    values = tuple(dict.fromkeys(values))
    places = [F.when(F.col(column).eqNullSafe(F.lit(v)), F.lit(i)) for i, v in enumerate(values)]
    placed = df.withColumn(folder, F.coalesce(*places, F.lit(-1)))
    # A folder's rows are dealt together, and split where they are many.
    placed.hint("rebalance", folder).write.mode("error").partitionBy(folder).parquet(path)
    return SkewedTable(df.sparkSession.read.schema(placed.schema).parquet(path), column, values, folder)


def matches(spec: PartitionSpec) -> Column:
    """Rows of a partition spec: every column with a value equals it."""
    tests = [F.col(c).eqNullSafe(F.lit(v)) for c, v in spec.items() if v is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def insert_into(df: DataFrame, table: str, spec: PartitionSpec | None = None) -> None:
    """``INSERT INTO table [PARTITION (spec)]``: append, columns by name.

    Columns given a value in ``spec`` are taken from it rather than from ``df``.
    """
    _insert("INTO", df, table, spec)


def insert_overwrite(
    df: DataFrame,
    table: str,
    spec: PartitionSpec | None = None,
    if_not_exists: bool = False,
    mode: str = "dynamic",
) -> None:
    """``INSERT OVERWRITE TABLE table [PARTITION (spec) [IF NOT EXISTS]]``.

    Without a spec the whole table is replaced, and with a value for every column
    that one partition. A spec with open columns replaces, in ``dynamic`` mode, the
    partitions the new rows fall in, and in ``static`` mode (Spark's default) every
    partition that agrees with the values given. ``if_not_exists`` needs a value
    for every column and writes nothing when the partition is there.
    """
    if if_not_exists and (not spec or any(v is None for v in spec.values())):
        raise ValueError("IF NOT EXISTS needs a value for every partition column")
    conf, setting = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(setting)
    conf.set(setting, mode if spec else "static")
    try:
        _insert("OVERWRITE", df, table, spec, "IF NOT EXISTS" if if_not_exists else "")
    finally:
        conf.set(setting, before)


def _insert(
    verb: str, df: DataFrame, table: str, spec: PartitionSpec | None, condition: str = ""
) -> None:
    spark = df.sparkSession
    spec = spec or {}
    fixed = {c for c, v in spec.items() if v is not None}
    columns = [f for f in spark.table(table).schema if f.name not in fixed]
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
    clause = ", ".join(f"`{c}`" + (f" = {_literal(v)}" if c in fixed else "") for c, v in spec.items())
    clause = clause.replace("{", "{{").replace("}", "}}")  # not a placeholder
    partition = f"PARTITION ({clause}) {condition}" if spec else ""
    spark.sql(f"INSERT {verb} TABLE {table} {partition} SELECT * FROM {{rows}}", rows=rows)


def _literal(value: Any) -> str:
    """A partition value as a quoted SQL string, which Spark casts to the column."""
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def write_directory(
    df: DataFrame, path: str, provider: str = "parquet", options: Mapping[str, str] | None = None
) -> None:
    """``INSERT OVERWRITE DIRECTORY path USING provider OPTIONS (…)``."""
    df.write.mode("overwrite").format(provider).options(**(options or {})).save(path)


def write_if_absent(df: DataFrame, path: str, override: bool = False) -> None:
    """Write unless the target exists; with ``override`` replace it."""
    df.write.mode("overwrite" if override else "ignore").parquet(path)


def write_partition_at(df: DataFrame, spec: PartitionSpec, path: str) -> None:
    """Write the rows of one partition spec to a location of its own."""
    df.filter(matches(spec)).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Branch:
    """One INSERT of a multi-insert: which rows, and which columns of them."""

    where: Column
    select: Mapping[str, Column]


def multi_insert(source: DataFrame, branches: Mapping[str, Branch], root: str) -> dict[str, str]:
    """``FROM source INSERT … SELECT … INSERT … SELECT …`` as one job.

    Every row is tagged with the sinks that take it and written once per sink, to
    ``root/sink=<name>``: a single pass over the source, nothing cached. Returns
    the location of each sink. A column only some branches have is null in the
    others.
    """
    names = list(dict.fromkeys(c for b in branches.values() for c in b.select))
    takers = F.array_compact(F.array(*[F.when(b.where, F.lit(n)) for n, b in branches.items()]))
    tagged = source.withColumn("sink", F.explode(takers))

    def column(name: str) -> Column:
        choices = [
            F.when(F.col("sink") == sink, branch.select[name])
            for sink, branch in branches.items()
            if name in branch.select
        ]
        return F.coalesce(*choices).alias(name)

    # Dealt by sink, large sinks split: else every task would write a file for every sink.
    dealt = tagged.select("sink", *[column(c) for c in names]).hint("rebalance", "sink")
    dealt.write.mode("overwrite").partitionBy("sink").parquet(root)
    return {name: f"{root}/sink={name}" for name in branches}


def write_batches(df: DataFrame, path: str, batches: int) -> None:
    """The same rows as CSV ``batches`` times, one job and one folder per batch.

    A task keeps a file open for each batch and writes rows as they come. They are not sorted by batch, so a task's
    memory does not grow with its rows; beyond ``OPEN_FILES`` batches Spark sorts the rows of those that are left.
    """
    numbers = F.explode(F.sequence(F.lit(1), F.lit(batches)))
    conf, setting = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(setting)
    conf.set(setting, str(min(batches, OPEN_FILES)))
    try:
        df.withColumn("batch", numbers).write.mode("error").partitionBy("batch").csv(path)
    finally:
        conf.set(setting, before)
