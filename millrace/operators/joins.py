"""Joins whose obvious Spark form does not survive large or skewed inputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import skew
from millrace.workdir import materialise

_VALUE = "__value"
BITS = 2  # a block is cut in 2 ** BITS blocks of the level below
STRETCH = 6  # points of 2 ** STRETCH integers meet the steps of aggregates over them
Merged = Mapping[str, tuple[Column, Callable[[str], Column]]]


def cross(left: DataFrame, right: DataFrame, rows: int = 1000) -> DataFrame:
    """``left CROSS JOIN right``, meant for a right side of a few rows.

    Up to ``rows`` rows go to every task once and ``left`` stays in place. Beyond
    that Spark pairs up partitions of both sides: exact, but as large as it sounds.
    """
    return left.crossJoin(skew.broadcast_if_small(right, rows))


def outer(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    how: str = "full",
    limit: int = skew.TASK_ROWS,
) -> DataFrame:
    """``left LEFT / RIGHT / FULL JOIN right ON`` equal columns, all columns kept.

    ``on`` maps columns of ``left`` to columns of ``right``; names must differ. AQE
    splits a skewed partition only on the preserved side of an outer join and, in
    a full one, on neither. When a key is hot on such a side the join is put
    together from an inner join, which AQE splits on both sides, and the rows
    without a partner, found by anti joins on distinct keys.
    """
    pairs = list(on.items())
    keys, partners = [a for a, _ in pairs], [b for _, b in pairs]
    condition = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in pairs])
    exposed = {"left": [(right, partners)], "right": [(left, keys)]}
    exposed["full"] = exposed["left"] + exposed["right"]
    if not any(skew.group_sizes(side.select(*by), by, limit).any_hot for side, by in exposed[how]):
        return left.join(right, condition, how)
    result = left.join(right, condition, "inner")
    if how in ("left", "full"):
        alone = left.join(right.select(*partners).distinct(), condition, "left_anti")
        result = result.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        alone = right.join(left.select(*keys).distinct(), condition, "left_anti")
        result = result.unionByName(alone, allowMissingColumns=True)
    return result


def full_using(
    left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = skew.TASK_ROWS
) -> DataFrame:
    """``left FULL OUTER JOIN right USING (keys)``: one column per key."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    joined = outer(left, renamed, {k: f"__right_{k}" for k in keys}, "full", limit)
    return joined.select(
        *[F.coalesce(k, f"__right_{k}").alias(k) for k in keys],
        *[c for c in joined.columns if c not in keys and not c.startswith("__right_")],
    )


def distinct_values(values: DataFrame) -> DataFrame:
    """The distinct values of a subquery's one column, written: computed once for every join that asks for them."""
    (name,) = values.columns
    return materialise(values.select(F.col(name).alias(_VALUE)).distinct(), "subquery")


def _known(values: DataFrame) -> DataFrame:
    return values if values.columns == [_VALUE] else distinct_values(values)


def is_in(left: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``left WHERE column IN (values)``; ``values`` has one column or comes from ``distinct_values``."""
    return left.join(_known(values), left[column] == F.col(_VALUE), "left_semi")


def not_in(left: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``left WHERE column NOT IN (values)`` with SQL's three-valued logic.

    ``values`` has one column or comes from ``distinct_values``. Spark's null-aware anti join broadcasts the whole
    subquery; this is an anti join on its distinct values, written once. Whether there are any, and a null among
    them, is one look at the written table: no value keeps every row, a null none.
    """
    known = _known(values)
    n, nulls = known.agg(F.count(F.lit(1)), F.count_if(F.col(_VALUE).isNull())).first()
    if not n:
        return left
    if nulls:
        return left.filter(F.lit(False))
    return left.filter(F.col(column).isNotNull()).join(known, left[column] == F.col(_VALUE), "left_anti")


def range_nodes(ranges: DataFrame, low: str, high: str, bits: int = BITS) -> DataFrame:
    """``ranges`` once for every aligned block their integers ``low <= i < high`` are made of: ``__level`` and ``__node``.

    A block of level ``k`` holds ``2 ** (bits * k)`` integers. A level has the blocks inside of the range that are in no
    block of the level above inside of it: less than ``2 ** bits`` at either end, on about log(length) levels.
    """
    levels = F.expr(f"sequence(0, cast(floor(log2(`{high}` - `{low}`) / {bits}) AS int))")
    rows = ranges.filter(F.col(low) < F.col(high)).withColumn("__level", F.explode(levels))

    def inside(level: str) -> tuple[str, str]:
        shift = f"{bits} * ({level})"
        return f"-shiftright(-`{low}`, {shift})", f"shiftright(`{high}`, {shift})"

    (start, end), (above, above_end) = inside("__level"), inside("least(__level + 1, 62 div " + str(bits) + ")")
    rows = rows.withColumns({"__start": F.expr(start), "__end": F.expr(end)})
    covered = F.expr(f"({above}) < ({above_end}) AND __level < {62 // bits}")
    first, last = F.expr(f"({above}) * {1 << bits}"), F.expr(f"({above_end}) * {1 << bits}")

    def numbers(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    start, end = F.col("__start"), F.col("__end")
    nodes = F.when(covered, F.concat(numbers(start, first), numbers(last, end))).otherwise(numbers(start, end))
    return rows.withColumn("__node", F.explode(nodes)).drop("__start", "__end")


def in_range(
    points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, bits: int = BITS, merged: Merged | None = None
) -> DataFrame:
    """``points JOIN ranges ON at >= low AND at < high`` on integer columns, within 62 bits.

    A join on inequalities alone compares every pair of rows. Here a range becomes the aligned blocks it is made of,
    of which there are about ``2 ** bits`` times the logarithm of its length, whether that is 1 or 10^9, and a point
    the blocks of every level in use that hold it, of which exactly one is in each range around it: an equi-join
    without false pairs. More ``bits`` give a range more rows and a point fewer. Few enough blocks are broadcast.

    Long ranges around many points make as many pairs as that. With ``merged`` there are none: a point that any range
    holds comes once, with its columns and those ``merged`` names, aggregates over all ranges around it. It maps each
    to a column of ``ranges`` and a function that may merge what it has merged: ``F.sum``, ``F.min``, ``F.max``.
    """
    if merged is not None:
        return _merged_in_range(points, at, ranges, low, high, bits, merged)
    nodes = materialise(range_nodes(ranges.withColumns({c: F.col(c).cast("bigint") for c in (low, high)}), low, high, bits), "range-nodes")
    kinds = {f.name: f.dataType for f in ranges.schema}
    return _at_nodes(points, at, nodes, bits).withColumns({c: F.col(c).cast(kinds[c]) for c in (low, high)})


def _at_nodes(points: DataFrame, at: str, nodes: DataFrame, bits: int) -> DataFrame:
    """``points`` joined with the rows of all blocks that hold them; ``nodes`` is a written table."""
    levels = sorted(r[0] for r in nodes.select("__level").distinct().collect())  # 62 / bits numbers at most
    level = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("__level")
    held = points.select("*", level).withColumn("__node", F.expr(f"shiftright(cast(`{at}` AS bigint), {bits} * __level)"))
    return held.join(skew.broadcast_if_small(nodes), ["__level", "__node"]).drop("__level", "__node")


def _merged_in_range(
    points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, bits: int, merged: Merged
) -> DataFrame:
    """``in_range`` with aggregates: these change only where a range begins or ends.

    The integers are cut into stretches of ``2 ** STRETCH``, and those that hold points at the ends of ranges into
    steps. Ranges are merged per aligned block, and blocks per step, so that a point meets the few steps of its stretch
    and moves once.
    """
    ends = ranges.select(F.col(low).cast("bigint").alias("__low"), F.col(high).cast("bigint").alias("__high"), *[v.alias(n) for n, (v, _) in merged.items()])
    merge = [function(name).alias(name) for name, (_, function) in merged.items()]
    nodes = range_nodes(ends, "__low", "__high", bits).groupBy("__level", "__node").agg(*merge)
    nodes = materialise(nodes, "range-nodes")
    stretch = F.shiftright(F.col(at).cast("bigint"), STRETCH)
    held = points.withColumn("__stretch", stretch)
    taken = materialise(held.select("__stretch").filter(F.col("__stretch").isNotNull()).distinct(), "stretches")
    edges = ends.filter("__low < __high").select(F.explode(F.array("__low", "__high")).alias("__from")).distinct()
    edges = edges.withColumn("__stretch", F.shiftright("__from", STRETCH)).join(taken, "__stretch", "left_semi")
    starts = taken.select(F.shiftleft("__stretch", STRETCH).alias("__from"), "__stretch")
    end = F.lead("__from").over(Window.partitionBy("__stretch").orderBy("__from"))  # 2 ** STRETCH rows at most
    steps = starts.unionByName(edges).distinct().withColumn(
        "__to", F.coalesce(end, F.shiftleft(F.col("__stretch") + 1, STRETCH))
    )
    found = _at_nodes(steps, "__from", nodes, bits).groupBy("__stretch", "__from", "__to").agg(*merge)
    found = skew.broadcast_if_small(materialise(found, "steps"))
    within = (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to"))
    return held.join(found, "__stretch").filter(within).select(*points.columns, *merged)
