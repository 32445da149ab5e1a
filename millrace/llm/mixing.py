"""Operator 5: how many copies of each document a mix of sources takes.

A document belongs to any number of sources. Documents are summed up by membership pattern (the
set of their sources); a minimum-cost flow routes the patterns' tokens to the sources' quotas, a
pattern's later copies costing more than its earlier ones. Every document of a pattern is then taken
the whole number of times the routed amount allows, and for what is left over documents come in a
seeded order until the amount is met, to within half the document at the cut.

The order is that of a hash of id and size. The cut is found in steps of 16 bits of it: sizes are summed by
their next 16 bits, the slice that holds the cut is worked out, and only its rows go on to the next
step, so no task ever sorts the documents of a pattern. A row's copies then follow from its own hash and its pattern's
cut. Rows whose hash is the cut have one size; where some of them come in and some do not, they are numbered by
range. Only the patterns' and sources' sums and cuts come to the driver: they grow with the number of patterns,
and not with that of documents.

Null texts have size zero; a null source is a source of its own, the last. A document of size
zero is taken zero words. Repeated rows are documents of their own; equal ones are interchangeable,
so results agree between runs. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import words
from millrace.llm.flow import route
from millrace.llm.frames import flat_texts, fresh, numbered, slices, written
from millrace.operators.skew import broadcast_if_small

WEIGHTS = (5, 2, 1)
SHARE, COPIES, SEED = 1.5, 2, 7
_STEPS = (48, 32, 16, 0)  # lowest bit of each step's 16 bits of the hash, of which the first is zero


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """``docs`` and the number of words (runs of anything but ASCII white space) of each ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_texts(batch.column("text"))
            counts = [
                words.spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words.INK_BYTES)[2]
                for a, b in slices(offsets, words.SLICE_BYTES)
            ]
            yield batch.append_column(name, pa.array(np.concatenate(counts) if counts else [], pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def capped_targets(sizes: dict, share: float = SHARE, cap: int = COPIES) -> dict:
    """``share`` times all sizes dealt to the sources by weights 5, 2, 1, repeating, in order of code
    points with null last; none gets more than ``cap`` times its size, and what is over is dealt anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    target, rest, to_deal = {}, names, share * sum(sizes.values())
    while rest:
        unit = to_deal / sum(weight[s] for s in rest)
        above = [s for s in rest if unit * weight[s] > cap * sizes[s]]
        if not above:
            return target | {s: unit * weight[s] for s in rest}
        target |= {s: float(cap * sizes[s]) for s in above}
        to_deal -= sum(cap * sizes[s] for s in above)
        rest = [s for s in rest if s not in target]
    return target


_PLAN = T.StructType([
    T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()),
    T.StructField("cut", T.LongType()), T.StructField("alike", T.LongType()), T.StructField("more", T.LongType()),
])


def _ordered(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``h``, 63 bits of a hash of ``doc_id`` and ``size``."""
    return docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed)), 1))


def _cuts(rows: DataFrame, over: dict[tuple, int]) -> dict[tuple, tuple[int, int, int]]:
    """For each pattern with a cut: the hash where its documents, in order, reach ``over`` words, how many have that
    hash, and how many of these come in.

    Without a cut all of its documents end before ``over``.
    """
    spark = rows.sparkSession
    left = [(list(p), 0, n) for p, n in over.items()]
    kind = "pattern array<string>, prefix bigint, over bigint"
    for low in _STEPS:
        known = broadcast_if_small(spark.createDataFrame(left, kind))
        found = rows.join(known, "pattern")
        if low < _STEPS[0]:
            found = found.filter(F.shiftright("h", low + 16) == F.col("prefix"))
        sums = found.groupBy("pattern", F.shiftright("h", low).alias("slice")).agg(
            F.sum("size").alias("words"), F.count("*").alias("alike"), F.first("over").alias("over")
        )
        order = Window.partitionBy("pattern").orderBy("slice")  # at most 65,536 rows
        before = F.sum("words").over(order) - F.col("words")
        at_cut = sums.withColumn("before", before).filter("before <= over AND before + words > over")
        cut = at_cut.select("pattern", "slice", (F.col("over") - F.col("before")).alias("over"), "words", "alike").collect()
        left = [(r["pattern"], r["slice"], r["over"]) for r in cut]  # at most a row a pattern
    # One more comes in when that ends nearer to the amount.
    size = {tuple(r["pattern"]): r["words"] // r["alike"] for r in cut}
    return {
        p: (r["slice"], r["alike"], min(r["alike"], (2 * r["over"] + size[p]) // (2 * size[p])))
        for r in cut for p in [tuple(r["pattern"])]
    }


def plan(sized: DataFrame, quotas: Callable[[dict], dict], copies: int) -> list[tuple]:
    """A row of ``_PLAN`` for each pattern of ``sized`` (``pattern, size, h``, written): what decides on its documents."""
    capacity = {
        tuple(r["pattern"]): r["total"]
        for r in sized.groupBy("pattern").agg(F.sum("size").alias("total")).orderBy("pattern").collect()
    }
    sizes: dict = {}
    for pattern, total in capacity.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + total
    target = quotas(sizes)
    given = route(capacity, {s: round(q) for s, q in target.items()}, copies)
    taken = {p: sum(g.values()) for p, g in given.items()}
    cuts = _cuts(sized, {p: taken[p] % total if total else 0 for p, total in capacity.items()})
    return [
        (list(p), sum(sizes[s] for s in p), float(sum(target[s] for s in p)), taken[p] // total if total else 0, *cuts.get(p, (None, 0, 0)))
        for p, total in capacity.items()
    ]


def _copied(rows: DataFrame, planned: list[tuple], copies: int) -> DataFrame:
    """``rows`` (``pattern, size, h`` and more) with their pattern's ``source_size`` and ``target``, and their ``copies``."""
    spark = rows.sparkSession
    known = rows.join(broadcast_if_small(spark.createDataFrame(planned, _PLAN)), "pattern")
    decided = known.withColumn("extra", F.expr("int(cut IS NULL OR h < cut OR h = cut AND more = alike)"))
    if any(0 < more < alike for *_, alike, more in planned):
        some = "h <=> cut AND more > 0 AND more < alike"
        place = numbered(known.filter(some), "pattern", ["doc_id", *(c for c in ("text",) if c in rows.columns)], size=fresh("all"))
        part = place.withColumn("extra", F.expr("int(rank < more)")).select(decided.columns)
        decided = decided.filter(f"NOT ({some})").unionByName(part)
    # Documents of size zero cost nothing and may stand before a cut at zero; they too keep to the limit.
    made = F.least(F.col("whole") + F.col("extra"), F.lit(copies)).cast("int")
    return decided.withColumn("copies", made).drop("whole", "cut", "alike", "more", "extra", "h")


def _pattern(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))


def mix(
    docs: DataFrame,
    sources: Column,
    quotas: Callable[[dict], dict] = capped_targets,
    copies: int = COPIES,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, pattern, size, source_size, target, copies, taken`` of every row of ``docs`` (``doc_id``, ``text``).

    ``sources`` is the array of sources of a row. ``quotas`` makes the words wanted of each source
    from the sources' sizes. ``taken`` is a whole number of copies, ``copies`` at most, times ``size``.
    ``copies`` is that number, and ``source_size`` and ``target`` are sums over the sources of the row's pattern.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint"), _pattern(sources).alias("pattern"), F.col("text").cast("string"))
    sized = written(_ordered(with_size(narrow).drop("text"), seed), "sizes")
    copied = _copied(sized, plan(sized, quotas, copies), copies)
    return copied.select(
        "doc_id", "pattern", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeated(
    docs: DataFrame,
    sources: Column,
    quotas: Callable[[dict], dict] = capped_targets,
    copies: int = COPIES,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs``, all columns, as often as a mix takes it; the arguments are those of ``mix``.

    Each row's copies follow from itself and its pattern's cut, so no row is looked up and no text is shuffled.
    """
    row = fresh("row")
    whole = docs.select(
        F.col("doc_id").cast("bigint"), _pattern(sources).alias("pattern"), F.col("text").cast("string"), F.struct("*").alias(row)
    )
    sized = _ordered(with_size(whole), seed)
    planned = plan(written(sized.select("pattern", "size", "h"), "sizes"), quotas, copies)
    copied = _copied(sized, planned, copies)
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return copied.select(f"{row}.*", times.alias(fresh("copy"))).select(*docs.columns)
