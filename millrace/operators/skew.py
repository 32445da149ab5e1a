"""Finding groups too large for one task, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workdir import materialise

# Rows of one group a single task is asked to sort or hold at most.
TASK_ROWS = 4_000_000
# Keys the frequent-items summary tracks, and the partial summaries that are merged side by side.
TRACKED_KEYS, MERGED_APART = 16_384, 128
LISTED_FILES = 1000  # files whose footers are asked for a bound
# Rows and bytes a table may have to be broadcast; what is larger is joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALT = "__salt"
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class GroupSizes:
    """Sizes of the groups of some keys, and the few groups above the limit."""

    rows: int  # at most this; exact where there are more than the limit
    largest: int  # at most this; exact where a group is above the limit
    hot: int  # groups above the limit
    hot_rows: int  # rows in them
    limit: int = TASK_ROWS
    keys: DataFrame | None = field(default=None, compare=False, repr=False)  # of the groups above the limit, written

    @property
    def any_hot(self) -> bool:
        return self.hot > 0


def match(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join on null-safe equality of ``keys``: a null key is a group like any other.

    ``right`` may be derived from ``left``; its key columns do not appear in the
    result. ``small`` broadcasts ``right``: for callers that have checked its size.
    """
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    joined = left.join(F.broadcast(renamed) if small else renamed, condition, how)
    return joined.drop(*[f"__right_{k}" for k in keys])


def most_rows(df: DataFrame) -> int | None:
    """A number of rows that ``df`` cannot exceed, where file footers tell: it filters or groups one Parquet table.

    None for any other plan, and for tables of so many files that the driver should not list them again.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines() if line.strip()]
    kept = all(line.startswith(("Project", "Filter", "Aggregate", "Sort", "Relation")) for line in lines)
    tables = [line for line in lines if line.startswith("Relation")]
    if not kept or len(tables) != 1 or not tables[0].rstrip().endswith("parquet"):
        return None
    files = df.inputFiles()
    if not files or len(files) > LISTED_FILES:
        return None
    return df.sparkSession.read.schema("any int").parquet(*files).count()  # no column is read


def group_sizes(df: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS) -> GroupSizes:
    """Measure the groups, in one job where none is above ``limit`` rows.

    A table whose files hold no more rows than that has no such group, which their footers tell. Else a frequent-items summary of the keys' hashes is built in the pass that reads the rows, in each task, and merged in
    two steps: no key is shuffled, however many there are. A summary that tracks ``TRACKED_KEYS`` keys misses none
    that has more than ``_least_found`` of all rows; its counts may be too high by as much and never too low. So
    the keys it finds above the limit are the only candidates, and those are counted exactly in a second pass over the
    key columns. Tables so large that the limit is below that share are counted key by key.
    """
    most = most_rows(df)
    if most is not None and most <= limit:
        return GroupSizes(most, most, 0, 0, limit)
    ident = F.xxhash64(*keys)
    apart = F.pmod(F.spark_partition_id(), F.lit(MERGED_APART)).alias("part")
    summaries = df.select(ident.alias("__ident"), apart).groupBy("part").agg(
        F.expr(f"approx_top_k_accumulate(__ident, {TRACKED_KEYS})").alias("state"), F.count(F.lit(1)).alias("n")
    )
    merged = summaries.groupBy(F.lit("all")).agg(  # without rows no group, and nothing to merge
        F.expr(f"approx_top_k_combine(state, {TRACKED_KEYS})").alias("state"), F.sum("n").alias("n")
    )
    most = TRACKED_KEYS // 5  # more than can be above any limit the summary serves
    row = merged.select("n", F.expr(f"approx_top_k_estimate(state, {most})").alias("found")).first()
    total = row["n"] if row else 0
    if total <= limit:
        return GroupSizes(total, total, 0, 0, limit)
    if limit > _least_found(total):
        idents = [(r["item"],) for r in row["found"] if r["count"] > limit]
        if not idents:
            return GroupSizes(total, limit, 0, 0, limit)
        candidates = F.broadcast(df.sparkSession.createDataFrame(idents, "__ident bigint"))  # at most ``most`` numbers
        df = df.select(*keys, ident.alias("__ident")).join(candidates, "__ident", "left_semi")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    hot = materialise(counted, "hot-keys")  # at most total / limit rows
    sums = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(limit))).first()
    return GroupSizes(total, sums[2], sums[0], sums[1], limit, hot.select(*keys))


def _least_found(rows: int) -> int:
    """Rows of a key that the summary cannot miss among ``rows``.

    The summary keeps 2 ** k >= TRACKED_KEYS / 0.75 counters; its counts are at most 3.5 * rows / 2 ** k too high, and it
    gives every key whose count less that error is above that error.
    """
    counters = 1 << (-(-TRACKED_KEYS * 4 // 3) - 1).bit_length()
    return 7 * rows // counters + 1


def split_hot(
    df: DataFrame, keys: Sequence[str], sizes: GroupSizes
) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows of the groups within the limit, rows of the larger ones (``sizes`` of the same keys)."""
    hot = sizes.keys.select(*keys)
    small = fits(hot)
    return match(df, hot, keys, "left_anti", small), match(df, hot, keys, "left_semi", small)


def salted(hot: DataFrame, sizes: GroupSizes) -> DataFrame:
    """``hot`` with a salt that cuts its largest group into parts within the limit.

    The salt counts rows off, so copies of one row spread as well. It is written
    out once: a task run again must not deal the same rows to other parts.
    """
    ways = -(-sizes.largest // sizes.limit)
    dealt = hot.withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(ways)))
    return materialise(dealt, "salted")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes.

    ``take`` goes through the partitions until it has enough, so on a large table
    this reads a few of them and gives up; only one number per row is fetched.
    """
    texts = [f.name for f in df.schema if not isinstance(f.dataType, _FIXED_WIDTH)]
    fixed = F.lit(8 * (len(df.columns) - len(texts)))
    width = fixed + F.octet_length(F.to_json(F.struct(*texts))) if texts else fixed
    widths = [row[0] for row in df.select(width).take(rows + 1)]
    return len(widths) <= rows and sum(widths) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its size allows, else leave the join to Spark.

    ``df`` is computed for the check and again for the join: where that is costly,
    pass a written table.
    """
    return F.broadcast(df) if fits(df, rows) else df
