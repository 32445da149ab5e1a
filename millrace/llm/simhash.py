"""Operator 9: near-duplicate documents by SimHash, linked by tiled exact comparison.

A text's words are its runs of anything but ASCII white space, with A-Z lower-cased; its
shingles are runs of ``shingle`` words joined by a space, repeats included (all words, when
there are fewer). Bit ``j`` of the fingerprint is set when more than half of the shingles' XXH64
values (seed 42) have it. Two fingerprints link when they differ in at most ``radius`` bits.

Only distinct fingerprints are compared. They are laid in tiles of equal bit counts of the
upper and of the lower half; two fingerprints that close have bit counts that close, so tile
pairs whose counts differ by more than the radius in all are skipped. A tile pair is one numpy
exclusive-or with bit counts. It returns a spanning forest of its links and no list of pairs, so
a group of copies of any size costs a row a member.

Empty, blank and null texts have fingerprint zero and link like any other. Repeated rows are
kept, each with its result. A null ``doc_id`` takes part, but never becomes a component's id
unless the component has no other. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.frames import written

SEED = 42
TILE = 2048  # fingerprints of a tile, about
CHUNK_TILES = 64  # tiles of one kind that meet their partners in one group of rows
_SHINGLES = 1 << 18  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _SHINGLES):
        spans = zip(starts[i : i + _SHINGLES], ends[i : i + _SHINGLES], strict=True)
        hashes = np.array([h(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    majority = 2 * counts > len(starts)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``carried`` and ``fp``: the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            values = np.array(fps, np.uint64).view(np.int64)
            own = {name: batch.column(name) for name in ("doc_id", *carried)}
            yield pa.record_batch(own | {"fp": pa.array(values)})

    narrow = docs.select(F.col("doc_id").cast("bigint"), *carried, F.col("text").cast("string"))
    kept = [f for f in narrow.schema.fields if f.name != "text"]
    return narrow.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _forest(near: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """Row and column numbers of each connected part of a boolean matrix that has a true cell."""
    rows_left, cols_left = near.any(axis=1), near.any(axis=0)
    while rows_left.any():
        rows = new_rows = np.array([int(rows_left.argmax())])
        rows_left[new_rows] = False
        cols = np.zeros(0, np.int64)
        while len(new_rows):
            new_cols = np.flatnonzero(near[new_rows].any(axis=0) & cols_left)
            cols_left[new_cols] = False
            cols = np.concatenate((cols, new_cols))
            new_rows = np.flatnonzero(near[:, new_cols].any(axis=1) & rows_left)
            rows_left[new_rows] = False
            rows = np.concatenate((rows, new_rows))
        yield rows, cols


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``a`` and ``b`` that are connected within the radius: a star for each part."""
    near = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 256):
        near[i : i + 256] = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius
    near &= a[:, None] != b[None, :]
    if not near.any():
        return a[:0], a[:0]
    some_rows, some_cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    ends, centres = [], []
    for rows, cols in _forest(near[np.ix_(some_rows, some_cols)]):
        members = np.unique(np.concatenate((a[some_rows[rows]], b[some_cols[cols]])))
        ends.append(members[1:])
        centres.append(np.full(len(members) - 1, members[0]))
    return np.concatenate(ends), np.concatenate(centres)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values.to_numpy() for c in ("a", "b"))
                u, v = tile_links(a.view(np.uint64), b.view(np.uint64), radius)
                if len(u):
                    yield pa.record_batch({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``u, v``: links that connect exactly what the pairs of ``fps`` (distinct ``fp``) within the radius do."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    kinds = fps.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(low).alias("lo"))
    sizes = kinds.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))  # at most 33 x 33 rows
    most = sizes.agg(F.max("tiles")).first()[0] or 1
    part = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = written(
        kinds.join(F.broadcast(sizes), ["hi", "lo"]).groupBy("hi", "lo", part.alias("part"))
        .agg(F.collect_list("fp").alias("fps")), "tiles",
    )
    # Each tile visits the kinds around its own; of two kinds only the smaller visits the other.
    # Tiles of a populous kind go in chunks, and every chunk meets a copy of its partners.
    around = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) >= (0, 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around]))
    left = tiles.select("*", steps.alias("step")).select(
        (F.col("hi") + F.col("step.i")).alias("hi"), (F.col("lo") + F.col("step.j")).alias("lo"),
        F.floor(F.col("part") / CHUNK_TILES).cast("int").alias("chunk"),
        F.col("part").alias("of"), F.expr("step.i = 0 AND step.j = 0").alias("own"), F.col("fps").alias("a"),
    )
    chunks = F.explode(F.sequence(F.lit(0), F.lit((most - 1) // CHUNK_TILES)))
    right = tiles.select("hi", "lo", "part", F.col("fps").alias("b"), chunks.alias("chunk"))
    pairs = left.join(right, ["hi", "lo", "chunk"]).filter("NOT own OR of <= part").select("a", "b")
    return pairs.mapInArrow(_compare(radius), "u bigint, v bigint")


def grouped(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = TILE, carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row of ``docs``, and its columns ``carried``.

    Rows that links join have one ``root``, a fingerprint, also where ids repeat or are null.
    """
    rows = written(fingerprints(docs, shingle, carried), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(nodes.select("fp"), radius, tile), "near").withColumnRenamed("u", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest ``doc_id`` that links reach.
    """
    return grouped(docs, shingle, radius, tile).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
