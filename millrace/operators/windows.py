"""Window functions that hold when one partition key has most of the rows.

Spark sorts each window partition in one task. That is the right plan while
every group fits a task, and it is the plan used here then. Groups above the
limit are cut once into consecutive pieces by a range partitioning on (keys, order),
for all functions over one window together. One aggregation gives a row of summaries
for each piece; the summaries of the pieces before, behind or all around combine, and what
a piece needs of them is joined to its rows, which are then windowed piece by piece.
No row is dropped and results equal the plain window's.

Every operator measures its groups unless the caller passes the sizes it already
has. ``order`` must be a total order within a group wherever a function needs one
(all but ``Rank`` and frames without bounds).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from millrace.operators import skew
from millrace.operators.skew import GroupSizes
from millrace.workdir import materialise

_PIECE, _SEQ, _HOME, _POS = "__piece", "__seq", "__home", "__pos"
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing
_AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _window(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _boxed(value: Column) -> Column:
    """A value that is there even when it is null."""
    return F.struct(value.alias("v"))


def _combined(function: str, a: Column, b: Column) -> Column:
    """The aggregate of two sets of rows from those of each; null where a set has no value."""
    if function in ("min", "max"):
        return (F.least if function == "min" else F.greatest)(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


@dataclass(frozen=True)
class Carried:
    """Windows over the summaries of a group's pieces: those before one, those behind it, all of them."""

    earlier: WindowSpec
    later: WindowSpec
    all: WindowSpec


class Function:
    """A column over a window, as Spark's own and in pieces.

    ``plain`` is Spark's. ``partials`` are aggregates over the rows of a piece, ``carries`` what a piece needs of
    those of others, and ``stitched`` the column from both and from a window over the piece. A frame of bounded
    reach borrows the rows that its piece's neighbours have within ``before`` and ``after``.
    """

    before = after = 0
    scans = True  # whether ``stitched`` needs a window over the piece

    def inputs(self, name: str) -> dict[str, Column]:
        """Columns that ``plain`` calls by name."""
        return {}

    def plain(self, name: str, keys: Sequence[str], order: Sequence[Column]) -> Column:
        raise NotImplementedError

    def partials(self, name: str) -> dict[str, Column]:
        return {}

    def carries(self, name: str, over: Carried) -> dict[str, Column]:
        return {}

    def stitched(self, name: str, local: WindowSpec) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class RowNumber(Function):
    """``row_number()`` as a long."""

    scans = False

    def plain(self, name, keys, order):
        return F.row_number().over(_window(keys, order)).cast("long")

    def stitched(self, name, local):
        return F.col(_POS)


@dataclass(frozen=True)
class Tile(Function):
    """``ntile(tiles)`` as a long: the first ``size mod tiles`` tiles of a group are one row longer."""

    tiles: int
    scans = False

    def plain(self, name, keys, order):
        return F.ntile(self.tiles).over(_window(keys, order)).cast("long")

    def stitched(self, name, local):
        short, longer = F.expr(f"__size div {self.tiles}"), F.expr(f"__size % {self.tiles}")
        at, edge = F.col(_POS) - 1, longer * (short + 1)
        in_long = F.floor(at / (short + 1)) + 1
        in_short = longer + F.floor((at - edge) / F.greatest(short, F.lit(1))) + 1
        return F.when(at < edge, in_long).otherwise(in_short)


@dataclass(frozen=True)
class RowsFrame(Function):
    """``function(column) OVER (… ROWS BETWEEN before PRECEDING AND after FOLLOWING)``, None for UNBOUNDED.

    ``function`` is sum, count, min, max or avg.
    """

    function: str
    column: Column
    before: int | None
    after: int | None

    def __post_init__(self):
        if any(reach is not None and reach < 0 for reach in (self.before, self.after)):
            raise ValueError("a frame reaches zero rows or more to either side")

    @property
    def scans(self) -> bool:
        return self.before is not None or self.after is not None

    @property
    def _bounded(self) -> bool:
        return self.before is not None and self.after is not None

    def _rows(self, window: WindowSpec) -> WindowSpec:
        start = _FIRST if self.before is None else -self.before
        return window.rowsBetween(start, _LAST if self.after is None else self.after)

    def plain(self, name, keys, order):
        window = _window(keys, order) if self.scans else Window.partitionBy(*keys)
        aggregate = {**_AGGREGATES, "avg": F.avg}[self.function](self.column)
        return aggregate.over(self._rows(window) if self.scans else window)

    def _parts(self) -> Sequence[str]:
        return ("sum", "count") if self.function == "avg" else (self.function,)

    def partials(self, name):
        if self._bounded:
            return {}
        return {f"__{part}_{name}": _AGGREGATES[part](self.column) for part in self._parts()}

    def carries(self, name, over):
        if self._bounded:
            return {}
        pieces = over.all if not self.scans else over.earlier if self.before is None else over.later
        merge = {**_AGGREGATES, "count": F.sum}
        return {f"__{part}_{name}": merge[part](f"__{part}_{name}").over(pieces) for part in self._parts()}

    def stitched(self, name, local):
        if self._bounded:
            return {**_AGGREGATES, "avg": F.avg}[self.function](self.column).over(self._rows(local))
        # Borrowed rows on the open side are in the carried summary already.
        own = F.col(_PIECE) >= F.col(_HOME) if self.before is None else F.col(_PIECE) <= F.col(_HOME)

        def total(part: str) -> Column:
            carried = F.col(f"__{part}_{name}")
            if not self.scans:
                return carried
            inside = _AGGREGATES[part](F.when(own, self.column)).over(self._rows(local))
            return _combined(part, carried, inside)

        return total("sum") / total("count") if self.function == "avg" else total(self.function)


def _running(function: str, column: Column) -> RowsFrame:
    return RowsFrame(function, column, None, 0)


@dataclass(frozen=True)
class _Counted(RowsFrame):
    """Rows with a value up to the current one: their numbers among all such rows."""

    function: str = "count"
    column: Column = field(default_factory=lambda: F.lit(1))
    before: int | None = None
    after: int | None = 0


@dataclass(frozen=True)
class Neighbour(Function):
    """``lag(column, back, default)``, or ``lead`` when ``back`` is negative; ``ignore_nulls`` counts values only."""

    column: Column
    back: int = 1
    default: object = None
    ignore_nulls: bool = False

    @property
    def before(self) -> int:
        return 0 if self.ignore_nulls else max(self.back, 0)

    @property
    def after(self) -> int:
        return 0 if self.ignore_nulls else max(-self.back, 0)

    def inputs(self, name):
        return {f"__in_{name}": self.column} if self.ignore_nulls else {}

    def plain(self, name, keys, order):
        if not self.ignore_nulls or not self.back:
            return F.lag(self.column, self.back, self.default).over(_window(keys, order))
        side, rows = ("lag", self.back) if self.back > 0 else ("lead", -self.back)
        found = F.expr(f"{side}(`__in_{name}`, {rows}) IGNORE NULLS").over(_window(keys, order))
        return found if self.default is None else F.coalesce(found, F.lit(self.default))

    def stitched(self, name, local):
        return F.lag(self.column, self.back, self.default).over(local)


@dataclass(frozen=True)
class _End(Function):
    """The first or last value up to the current row, or of the ``whole`` group; ``ignore_nulls`` skips nulls."""

    column: Column
    ignore_nulls: bool = False
    whole: bool = False
    _by = None

    @property
    def scans(self) -> bool:
        return not self.whole and self.ignore_nulls

    def _value(self, boxed: Column) -> Column:
        return F.when(self.column.isNotNull(), boxed) if self.ignore_nulls else boxed

    def _window(self, keys, order) -> WindowSpec:
        return _window(keys, order).rowsBetween(_FIRST, _LAST if self.whole else 0)

    def partials(self, name):
        value = _boxed(self.column)
        by = F.when(self.column.isNotNull(), F.col(_SEQ)) if self.ignore_nulls else F.col(_SEQ)
        return {f"__end_{name}": self._by(value, by)}


class First(_End):
    """``first_value(column)``."""

    _by = staticmethod(F.min_by)

    def plain(self, name, keys, order):
        return F.first(self.column, self.ignore_nulls).over(self._window(keys, order))

    def carries(self, name, over):
        pieces = over.earlier if self.scans else over.all
        return {f"__end_{name}": F.first(f"__end_{name}", True).over(pieces)}

    def stitched(self, name, local):
        carried = F.col(f"__end_{name}.v")
        if not self.scans:
            return carried
        own = F.when(F.col(_PIECE) == F.col(_HOME), self.column)
        return F.coalesce(carried, F.first(own, True).over(local.rowsBetween(_FIRST, 0)))


class Last(_End):
    """``last_value(column)``."""

    _by = staticmethod(F.max_by)

    def plain(self, name, keys, order):
        return F.last(self.column, self.ignore_nulls).over(self._window(keys, order))

    def carries(self, name, over):
        pieces = over.earlier if self.scans else over.all
        return {f"__end_{name}": F.last(f"__end_{name}", True).over(pieces)}

    def stitched(self, name, local):
        carried = F.col(f"__end_{name}.v")
        if not self.scans:
            return carried if self.whole else self.column
        own = F.when(F.col(_PIECE) == F.col(_HOME), self.column)
        return F.coalesce(F.last(own, True).over(local.rowsBetween(_FIRST, 0)), carried)


@dataclass(frozen=True)
class Nth(Function):
    """``nth_value(column, n)`` up to the current row, or of the ``whole`` group; ``ignore_nulls`` counts values only."""

    column: Column
    n: int
    ignore_nulls: bool = False
    whole: bool = False

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("rows are counted from one")

    def plain(self, name, keys, order):
        frame = _window(keys, order).rowsBetween(_FIRST, _LAST if self.whole else 0)
        return F.nth_value(self.column, self.n, self.ignore_nulls).over(frame)


_RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


@dataclass(frozen=True)
class Rank(Function):
    """``rank()``, ``dense_rank()`` (longs), ``percent_rank()`` or ``cume_dist()`` over columns of its own, ascending unless listed.

    It depends on the distinct values only, so in a hot group rows are counted per value first and even one value with
    most rows is a single row by the time anything is sorted.
    """

    kind: str
    columns: Sequence[str]
    descending: Sequence[str] = ()

    def sorting(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if c in self.descending else F.col(c).asc_nulls_first() for c in self.columns]

    def plain(self, name, keys, order):
        ranked = _RANKS[self.kind]().over(_window(keys, self.sorting()))
        return ranked.cast("long") if self.kind in ("rank", "dense_rank") else ranked

    def of(self) -> Column:
        """The rank from the rows up to a value, before it, the distinct ones and all."""
        others = F.col("__size") - 1
        return {
            "rank": F.col("__below") + 1,
            "dense_rank": F.col("__dense"),
            "percent_rank": F.when(others == 0, 0.0).otherwise(F.col("__below") / others),
            "cume_dist": F.col("__upto") / F.col("__size"),
        }[self.kind]


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    functions: Mapping[str, Function],
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``df`` with all ``functions`` over one window, ``PARTITION BY keys ORDER BY order``.

    Hot groups are cut and written once, with one table of summaries, whatever the number of functions; the others
    are windowed as they are.
    """

    def plain(part: DataFrame) -> DataFrame:
        inputs = {called: c for out, f in functions.items() for called, c in f.inputs(out).items()}
        columns = {out: f.plain(out, keys, order) for out, f in functions.items()}
        return part.withColumns(inputs).withColumns(columns).drop(*inputs)

    sizes = sizes or skew.group_sizes(df, keys)
    whole = plain(df)
    if not sizes.any_hot:
        return whole
    cold, hot = skew.split_hot(df, keys, sizes)
    found = _windowed_hot(hot, keys, order, functions, sizes)
    typed = [F.col(out).cast(whole.schema[out].dataType).alias(out) for out in functions]
    return plain(cold).unionByName(found.select(*df.columns, *typed))


def _cut(
    hot: DataFrame, keys: Sequence[str], order: Sequence[Column], sizes: GroupSizes
) -> DataFrame:
    """Hot rows with the id of their piece and their sequence within it; without an order, as they lie.

    The placement is written out once: the range bounds are sampled, and totals
    and rows have to see the very same pieces.
    """
    if order:
        by = [*[F.col(k) for k in keys], *order]
        pieces = max(2, -(-2 * sizes.hot_rows // sizes.limit))
        hot = hot.repartitionByRange(pieces, *by).sortWithinPartitions(*by)
    placed = hot.withColumn(_PIECE, F.spark_partition_id()).withColumn(_SEQ, F.monotonically_increasing_id())
    return materialise(placed, "window-pieces")


def _summaries(placed: DataFrame, keys: Sequence[str], functions: Mapping[str, Function]) -> DataFrame:
    """A written row for each piece of a group: its rows and the partial aggregates of the functions."""
    own = {"__n": F.count(F.lit(1)), "__first": F.min(_SEQ)}
    own |= {part: c for out, f in functions.items() for part, c in f.partials(out).items()}
    return materialise(placed.groupBy(*keys, _PIECE).agg(*[c.alias(part) for part, c in own.items()]), "piece-totals")


def _carried(totals: DataFrame, keys: Sequence[str], functions: Mapping[str, Function], reach: tuple[int, int]) -> DataFrame:
    """What each piece needs of the others: for its numbers, its functions, and whom it lends rows to."""
    ordered = Window.partitionBy(*keys).orderBy(_PIECE)
    over = Carried(ordered.rowsBetween(_FIRST, -1), ordered.rowsBetween(1, _LAST), ordered.rowsBetween(_FIRST, _LAST))
    columns = {"__ahead": F.coalesce(F.sum("__n").over(over.earlier), F.lit(0)), "__size": F.sum("__n").over(over.all)}
    columns |= {part: c for out, f in functions.items() for part, c in f.carries(out, over).items()}
    found = totals.select(*keys, _PIECE, "__n", "__first", *[c.alias(part) for part, c in columns.items()])
    before, after = reach
    if before or after:
        longest = totals.agg(F.max("__n")).first()[0] or 0
        near = Window.partitionBy(*keys).orderBy("__ahead").rangeBetween(-(longest + after), longest + before)
        found = found.withColumn("__near", F.collect_list(F.struct(_PIECE, "__ahead", "__n")).over(near))
    return found


def _at_home(rows: DataFrame, reach: tuple[int, int]) -> DataFrame:
    """Every row once for its own piece, and once for each other within whose reach it is."""
    before, after = reach
    if not (before or after):
        return rows.withColumn(_HOME, F.col(_PIECE))

    def within(piece: Column) -> Column:
        start, end = piece["__ahead"] + 1, piece["__ahead"] + piece["__n"]
        return (F.col(_POS) >= start - before) & (F.col(_POS) <= end + after)

    homes = F.transform(F.filter("__near", within), lambda piece: piece[_PIECE])
    return rows.withColumn(_HOME, F.explode(homes)).drop("__near")


def _looked_up(f: Function) -> bool:
    """Whether a value is found by its number among the group's rows or values."""
    return isinstance(f, Nth) or isinstance(f, Neighbour) and f.ignore_nulls and f.back != 0


def _windowed_hot(
    hot: DataFrame, keys: Sequence[str], order: Sequence[Column], functions: Mapping[str, Function], sizes: GroupSizes
) -> DataFrame:
    ranks = {out: f for out, f in functions.items() if isinstance(f, Rank)}
    looked_up = {out: f for out, f in functions.items() if _looked_up(f)}
    numbers: dict[str, Function] = {
        f"__number_{out}": _Counted(column=f.column) if f.ignore_nulls else RowNumber() for out, f in looked_up.items()
    }
    direct = {out: f for out, f in functions.items() if out not in ranks and out not in looked_up} | numbers
    placed = _cut(hot, keys, order, sizes)
    rows = _stitched(placed, keys, direct, hot.columns) if direct else placed.select(*hot.columns)
    if looked_up:
        rows = _with_values(materialise(rows, "window-numbers"), keys, looked_up)
    for columns in {tuple(f.columns): f for f in ranks.values()}:
        for down in {tuple(f.descending) for f in ranks.values() if tuple(f.columns) == columns}:
            own = {out: f for out, f in ranks.items() if (tuple(f.columns), tuple(f.descending)) == (columns, down)}
            rows = skew.match(rows, _value_ranks(placed, keys, own, sizes.limit), [*keys, *columns])
    return rows


def _stitched(placed: DataFrame, keys: Sequence[str], functions: Mapping[str, Function], columns: Sequence[str]) -> DataFrame:
    """The placed rows with their functions, from one window over each piece."""
    scans = [f for f in functions.values() if f.scans]
    reach = max((f.before or 0 for f in scans), default=0), max((f.after or 0 for f in scans), default=0)
    totals = _carried(_summaries(placed, keys, functions), keys, functions, reach)
    # Pieces are consecutive ranges: at most hot groups + pieces rows, checked before the broadcast.
    rows = skew.match(placed, totals, [*keys, _PIECE], "inner", skew.fits(totals))
    rows = rows.withColumn(_POS, F.col(_SEQ) - F.col("__first") + 1 + F.col("__ahead"))
    if scans:
        rows = _at_home(rows, reach)
    local = Window.partitionBy(*keys, _HOME).orderBy(_SEQ)
    rows = rows.withColumns({out: f.stitched(out, local) for out, f in functions.items()})
    if scans:
        rows = rows.filter(F.col(_PIECE) == F.col(_HOME))
    return rows.select(*columns, *functions)


def _with_values(rows: DataFrame, keys: Sequence[str], functions: Mapping[str, Function]) -> DataFrame:
    """Written rows with the values that stand at certain numbers of their group: equi-joins on (keys, number)."""
    for out, f in functions.items():
        number, value = f"__number_{out}", f"__value_{out}"
        numbered = rows.filter(f.column.isNotNull()) if f.ignore_nulls else rows
        values = numbered.select(*keys, F.col(number).alias("__at"), _boxed(f.column).alias(value))
        if isinstance(f, Nth):
            one = values.filter(F.col("__at") == f.n).drop("__at")  # a row a group
            rows = skew.match(rows, one, keys, "left", skew.fits(one))
            found = F.col(f"{value}.v")
            rows = rows.withColumn(out, found if f.whole else F.when(F.col(number) >= f.n, found))
        else:
            # A row's number counts the values up to and with its own.
            at = F.col(number) - F.when(f.column.isNotNull(), F.lit(f.back)).otherwise(F.lit(f.back - (f.back > 0)))
            rows = skew.match(rows.withColumn("__at", at), values, [*keys, "__at"], "left").drop("__at")
            found = F.col(f"{value}.v")
            rows = rows.withColumn(out, found if f.default is None else F.coalesce(found, F.lit(f.default)))
        rows = rows.drop(value)
    return rows.drop(*[f"__number_{out}" for out in functions])


def _value_ranks(placed: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank], limit: int) -> DataFrame:
    """Ranks of the distinct values of a group, from the rows and values up to each."""
    some = next(iter(ranks.values()))
    values = placed.groupBy(*keys, *some.columns).agg(F.count(F.lit(1)).alias("__ties"))
    steps = {
        "__upto": _running("sum", F.col("__ties")),
        "__dense": _running("count", F.lit(1)),
        "__size": RowsFrame("sum", F.col("__ties"), None, None),
    }
    values = materialise(values, "window-values")
    ranked = windowed(values, keys, some.sorting(), steps, skew.group_sizes(values, keys, limit))
    ranked = ranked.withColumn("__below", F.col("__upto") - F.col("__ties"))
    return ranked.select(*keys, *some.columns, *[f.of().alias(out) for out, f in ranks.items()])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_number",
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` as a long column."""
    return windowed(df, keys, order, {name: RowNumber()}, sizes)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Running sums: ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW per group."""
    return windowed(df, keys, order, {out: _running("sum", c) for out, c in sums.items()}, sizes)


def rows_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    frames: Mapping[str, RowsFrame | Neighbour],
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Columns over ROWS frames and neighbouring rows."""
    return windowed(df, keys, order, frames, sizes)


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
    dense_rank: str = "dense_rank",
    sizes: GroupSizes | None = None,
    descending: Sequence[str] = (),
) -> DataFrame:
    """``rank()`` and ``dense_rank()`` over ``order``, ascending unless listed."""
    ranks = {rank: Rank("rank", order, descending), dense_rank: Rank("dense_rank", order, descending)}
    return windowed(df, keys, [], ranks, sizes)


def share_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    percent_rank: str = "percent_rank",
    cume_dist: str = "cume_dist",
    sizes: GroupSizes | None = None,
    descending: Sequence[str] = (),
) -> DataFrame:
    """``percent_rank()`` and ``cume_dist()``, ascending unless listed."""
    shares = {percent_rank: Rank("percent_rank", order, descending), cume_dist: Rank("cume_dist", order, descending)}
    return windowed(df, keys, [], shares, sizes)


def tile_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    tiles: int,
    number: str = "row_number",
    tile: str = "ntile",
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``row_number()`` and ``ntile(tiles)``."""
    return windowed(df, keys, order, {number: RowNumber(), tile: Tile(tiles)}, sizes)


def group_totals(
    df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], sizes: GroupSizes | None = None
) -> DataFrame:
    """Any aggregates over whole window partitions: ``count(*) OVER (PARTITION BY keys)``.

    A window buffers its partition in one task. With a hot group the aggregate is
    combined map-side and joined back, which AQE can split.
    """
    sizes = sizes or skew.group_sizes(df, keys)
    whole = Window.partitionBy(*keys)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumns({out: c.over(whole) for out, c in totals.items()})

    if not sizes.any_hot:
        return plain(df)
    cold, hot = skew.split_hot(df, keys, sizes)
    hot = materialise(hot, "window-hot")
    per_group = hot.groupBy(*keys).agg(*[c.alias(out) for out, c in totals.items()])
    return plain(cold).unionByName(skew.match(hot, per_group, keys))


def ends(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    first: str,
    last: str,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``first_value`` and ``last_value`` of a column over whole ordered partitions."""
    both = {first: First(F.col(value), whole=True), last: Last(F.col(value), whole=True)}
    return windowed(df, keys, [F.col(c).asc() for c in order], both, sizes)


@dataclass(frozen=True)
class RangeFrame:
    """``function(column) OVER (… RANGE BETWEEN before PRECEDING AND after FOLLOWING)``.

    ``function`` is sum, count, min or max; averages follow from sum and count.
    """

    function: str
    column: Column
    before: int
    after: int

    def __post_init__(self):
        if self.before < 0 or self.after < 0:
            raise ValueError("a frame reaches zero values or more to either side")

    def partial(self) -> Column:
        return _AGGREGATES[self.function](self.column)

    def merged(self, partial: Column, over: WindowSpec) -> Column:
        merge = F.sum if self.function == "count" else _AGGREGATES[self.function]
        return merge(partial).over(over.rangeBetween(-self.before, self.after))


def range_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: Mapping[str, RangeFrame],
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Aggregates over RANGE frames along ``order``, an integer column.

    Rows with one order value share their frames. In hot groups rows are therefore
    aggregated per value first; the values are cut into buckets as wide as the
    widest reach, and each bucket borrows the values its neighbours have within
    reach. A task then sorts three reaches of distinct values at most, however many
    rows have them, so measure ``order`` in units that keep the reach to millions
    (seconds rather than microseconds for a day). The frames are joined back.
    """
    over = Window.partitionBy(*keys).orderBy(order)
    plain = {
        out: f.partial().over(over.rangeBetween(-f.before, f.after)) for out, f in frames.items()
    }
    sizes = sizes or skew.group_sizes(df, keys)
    whole = df.withColumns(plain)
    if not sizes.any_hot:
        return whole
    cold, hot = skew.split_hot(df, keys, sizes)
    before = max(f.before for f in frames.values())
    after = max(f.after for f in frames.values())
    width = max(before, after, 1)
    values = hot.groupBy(*keys, order).agg(*[f.partial().alias(out) for out, f in frames.items()])
    offset = F.pmod(F.col(order), F.lit(width))
    bucket = F.expr(f"(`{order}` - pmod(`{order}`, {width})) div {width}")
    homes = F.when(F.col(order).isNull(), F.array(F.lit(None).cast("long"))).otherwise(
        F.array_compact(
            F.array(
                bucket,
                F.when(offset >= width - before, bucket + 1),
                F.when(offset < after, bucket - 1),
            )
        )
    )
    spread = values.withColumn("__home", bucket).withColumn("__bucket", F.explode(homes))
    local = Window.partitionBy(*keys, "__bucket").orderBy(order)
    framed = (
        spread.select(
            *keys,
            order,
            "__home",
            "__bucket",
            *[f.merged(F.col(out), local).cast(whole.schema[out].dataType).alias(out) for out, f in frames.items()],
        )
        .filter(F.col("__bucket").eqNullSafe(F.col("__home")))
        .drop("__home", "__bucket")
    )
    return cold.withColumns(plain).unionByName(skew.match(hot, framed, [*keys, order]))
