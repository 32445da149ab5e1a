"""``MAKE SNAPSHOT target [DIRECTORY path] FROM source PARTITION (…) PARTITION (…)``.

The statement has no meaning of its own where it comes from, it only parses. Here
it copies the selected partitions of a table to parquet and returns a manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.sinks import PartitionSpec, matches
from millrace.workdir import fresh_path


def row_checksum(columns: Sequence[str]) -> Column:
    """A 32-bit number from the columns' text; a null differs from an empty text.

    Each value goes in with its length in front, so no two rows read alike.
    """
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n")))
    digest = F.md5(F.concat(*parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def make_snapshot(
    source: DataFrame,
    target: str,
    path: str | None = None,
    partitions: Sequence[PartitionSpec] = (),
    partition_by: Sequence[str] = (),
    checksum: Sequence[str] | None = None,
) -> DataFrame:
    """Copy the rows any of the partition specs selects, and describe the copy.

    No spec selects every row; a column without a value in a spec matches any.
    The copy fails when ``target`` or ``path`` already exists. The manifest has one
    row per partition with its row count and a checksum that does not depend on the
    order of rows, both computed from what was written.
    """
    spark = source.sparkSession
    by = list(partition_by) or list(dict.fromkeys(c for spec in partitions for c in spec))
    selected = source
    if partitions:
        selected = source.filter(reduce(Column.__or__, [matches(spec) for spec in partitions]))
    path = path or fresh_path(spark, target)
    writer = selected.write.mode("error").format("parquet").option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    writer.saveAsTable(target)
    columns = list(checksum or [c for c in source.columns if c not in by])
    return (
        spark.table(target)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(row_checksum(columns).cast("decimal(28,0)")).alias("checksum"),  # never overflows
        )
    )
