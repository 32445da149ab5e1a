"""Operator 6: nearest neighbours by cosine, from randomly rotated one-bit codes.

The index holds each unit vector, turned by one random rotation, as its signs (a bit a dimension) and
one correction number: how long the vector's shadow is on its own code. A query, turned alike, is rounded to a few
bits a dimension and held as bit planes, so that its inner product with a code is a few AND and bit counts on whole
words, no code being unpacked; that over the shadow estimates the cosine. What the code misses of the vector, and the
rounding of the query, is spread at random by the rotation, which bounds the error to ``bound`` standard deviations.
A task reranks, with the original vectors in double precision, each candidate whose upper bound reaches the k-th
exact cosine that it knows of; only those vectors are decoded. The tasks' k best are merged.

Every row is indexed, and a stated query set is held in blocks against all rows: a block of at most ``BLOCK`` queries
and ``BLOCK_VALUES`` components is sent to the tasks, its answers are written, and it is dropped before the next, so
neither the driver nor a task ever holds more than a block, however many queries there are.

Vectors that are null, zero, or hold null or non-finite components take no part, on either side; the same
goes for those whose length differs from the most frequent one's. A row is no candidate of a query with its
id; rows repeated under one id are candidates each, and queried once, by the smallest vector. Rows without an
id are candidates only. Ties go to the smaller id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import workdir
from millrace.llm.frames import written

K, BOUND, SEED = 5, 1.9, 3
PLANES = 3  # bits a component of a query
BLOCK, BLOCK_VALUES = 16384, 1 << 21  # queries, and their components, sent to the tasks at once
_ROWS = 2048  # candidates coded or compared at once
_QUERIES = 256
_SLACK = 1e-5  # rounding of the estimates, which are in single precision


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal factor of a normal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _matrix(column, dimensions: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dimensions`` components, in double precision."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors and the unit vectors' inner products with their codes."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part, all of one length."""
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("bigint"), vector.alias("embedding")).filter(
        "embedding IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c"))
    usual = lengths.orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("embedding") == (usual["n"] if usual else 0))


def build_index(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``vec_id, embedding, code, shadow`` of every usable row, as a written table."""
    usable_rows = usable(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(batch.column("embedding")[0])
            turn = rotation(n, seed) if turn is None else turn
            codes, shadows = encode(_scaled(_matrix(batch.column("embedding"), n)), turn)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "embedding": batch.column("embedding"),
                "code": pa.array([c.tobytes() for c in codes], pa.binary()), "shadow": pa.array(shadows),
            })

    return written(usable_rows.mapInArrow(run, "vec_id bigint, embedding array<double>, code binary, shadow double"), "codes")


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component is near one, by powers of two: squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _with_squares(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = _scaled(vectors)
    return scaled, (scaled * scaled).sum(axis=1)


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return order[place < k]


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words, a row a word: ``[word, vector]``."""
    n, width = packed.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = packed
    return np.ascontiguousarray(padded.view(np.uint64).T)


@dataclass(frozen=True)
class Planes:
    """Unit vectors rounded to ``low + step * level`` a component, the levels' bits packed by place.

    ``scale`` is what the rounded vector is multiplied by to be nearest to the vector, ``missed`` how far it then is.
    """

    bits: np.ndarray  # [plane, word, query], highest place first
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray  # sum of the rounded components
    scale: np.ndarray
    missed: np.ndarray

    def products(self, part: slice, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of some of the vectors with codes taken as signs; ``ones`` counts a code's set bits."""
        shape = self.low[part].size, codes.shape[1]
        both, count, levels = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.zeros(shape, np.uint32)
        for place, plane in enumerate(self.bits):
            if place:
                np.left_shift(levels, 1, out=levels)
            for mine, theirs in zip(plane, codes, strict=True):
                np.bitwise_and(mine[part, None], theirs[None], out=both)
                np.add(levels, np.bitwise_count(both, out=count), out=levels)
        low, step, total = (2 * self.low * self.scale)[part], (2 * self.step * self.scale)[part], (self.total * self.scale)[part]
        out = levels.astype(np.float32)
        out *= step[:, None].astype(np.float32)
        out += (low[:, None] * ones[None] - total[:, None]).astype(np.float32)
        return out


def planes(unit: np.ndarray, places: int = PLANES) -> Planes:
    """Vectors in ``places`` bits a component, evenly between their largest component's both signs."""
    most = np.abs(unit).max(axis=1)
    step = 2 * most / (2**places - 1)
    levels = np.rint((unit + most[:, None]) / step[:, None]).astype(np.uint8)
    rounded = step[:, None] * levels - most[:, None]
    scale = (unit * rounded).sum(axis=1) / (rounded * rounded).sum(axis=1)
    missed = np.linalg.norm(unit - scale[:, None] * rounded, axis=1)
    bits = np.stack([_words(np.packbits(levels >> p & 1, axis=1)) for p in range(places - 1, -1, -1)])
    return Planes(bits, -most, step, rounded.sum(axis=1), scale, missed)


def _search(block, k: int, bound: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vectors = block.value
        n = q_vectors.shape[1]
        q_vectors, q_squares = _with_squares(q_vectors)
        rounded = planes(q_vectors / np.sqrt(q_squares)[:, None] @ rotation(n, seed))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, id, exact score
        kth = np.full(len(q_ids), -np.inf)  # each query's k-th best exact cosine so far
        for batch in batches:
            every_id = batch.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            every_code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(every_id), -1)
            for i in range(0, len(every_id), _ROWS):
                ids, codes = every_id[i : i + _ROWS], _words(every_code[i : i + _ROWS])
                shadow = batch.column("shadow").to_numpy()[i : i + _ROWS]
                ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
                vectors = batch.column("embedding").slice(i, _ROWS)

                def cosines(query: np.ndarray, row: np.ndarray, vectors=vectors) -> np.ndarray:
                    used, at = np.unique(row, return_inverse=True)
                    mine, squares = _with_squares(_matrix(vectors.take(pa.array(used)), n))
                    return np.einsum("ij,ij->i", q_vectors[query], mine[at]) / np.sqrt(q_squares[query] * squares[at])

                for j in range(0, len(q_ids), _QUERIES):
                    part = slice(j, j + _QUERIES)
                    estimate = rounded.products(part, codes, ones)
                    estimate *= (1 / (np.sqrt(n) * shadow)).astype(np.float32)
                    least = kth[part].copy()
                    new = np.flatnonzero(least == -np.inf)  # too few known: their best estimates give a k-th cosine
                    if len(new) and len(ids) > k:
                        top = np.argpartition(estimate[new], -k - 1, axis=1)[:, -k - 1 :]
                        query, row = np.repeat(new + j, k + 1), top.ravel()
                        exact = np.where(q_ids[query] == ids[row], -np.inf, cosines(query, row)).reshape(top.shape)
                        least[new] = np.sort(exact, axis=1)[:, 1]
                    missed = (1 - shadow**2).clip(0) / max(n - 1, 1) + rounded.missed[part].max() ** 2 / n
                    estimate += (bound * np.sqrt(missed) / shadow + _SLACK).astype(np.float32)
                    query, row = np.nonzero(estimate >= least[:, None].astype(np.float32))
                    other = q_ids[query + j] != ids[row]
                    query, row = query[other] + j, row[other]
                    if not len(query):
                        continue
                    exact = cosines(query, row)
                    good = exact >= np.maximum(kth[query], least[query - j] - _SLACK)  # the k best are among these
                    found = [np.concatenate(x) for x in zip(best, (query[good], ids[row[good]], exact[good]), strict=True)]
                    keep = _top(*found, k)
                    best = [x[keep] for x in found]  # by query, best first
                    full = np.flatnonzero(np.arange(len(keep)) - np.searchsorted(best[0], best[0]) == k - 1)
                    kth[best[0][full]] = best[2][full]
        if len(best[0]):
            yield pa.record_batch({
                "query_id": pa.array(q_ids[best[0]]),
                "vec_id": pa.array(best[1], mask=best[1] == np.iinfo(np.int64).max), "score": pa.array(best[2]),
            })

    return run


def search(index: DataFrame, queries: Column, k: int = K, bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every row of ``index`` that ``queries`` chooses."""
    spark = index.sparkSession
    asked = index.filter(queries).filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "queries")
    number, dimensions = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = -(-number // max(1, min(BLOCK, BLOCK_VALUES // dimensions)))  # dealt by hash
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    path, schema = workdir.fresh_path(spark, "answers"), "query_id bigint, rank int, vec_id bigint, score double"
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if rows.num_rows:
            block = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), _matrix(rows["embedding"].combine_chunks(), dimensions)))
            found = index.mapInArrow(_search(block, k, bound, seed), "query_id bigint, vec_id bigint, score double")
            ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            block.destroy()
    return spark.read.schema(schema).parquet(path) if number else spark.createDataFrame([], schema)
