"""Nearest neighbours (operator 6) against all cosines."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace.llm import neighbours
from millrace.llm.frames import prepared

SF_DIR = "/root/testdata/sf0.1"


def brute(ids, x, queries, k=5):
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        score = (x * x[q]).sum(1) / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    table = pq.read_table(f"{SF_DIR}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    want = brute(ids, x, np.flatnonzero(ids % 50 == 0))
    rows = contract.queries()["op6_neighbours"](spark, SF_DIR).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    place = {int(i): k for k, i in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        assert [r for *_, r in found] == [1, 2, 3, 4, 5]
        assert [s for _, s, _ in found] == sorted((s for _, s, _ in found), reverse=True)
        for v, s, _ in found:
            a, b = x[place[q]], x[place[v]]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        hits += len({v for v, *_ in found} & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.97


def test_every_candidate_is_reranked_under_a_wide_bound(spark):
    prepared(spark)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).round(1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = neighbours.search(neighbours.build_index(docs), F.col("vec_id") < 20, k=3, bound=9.0).collect()
    want = brute(np.arange(300), x, range(20), 3)
    got = {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(20)}
    assert got == {q: [v for v, _ in w] for q, w in want.items()}


def test_odd_vectors(spark):
    prepared(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]),
        (50, [0.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (350, [1.0, 1.0, 1.0]),
        (None, [0.0, 2.0]), (51, [1e300, 1e300]), (52, [1e-300, 0.0]),
    ]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, code string, rank int")
    found = neighbours.search(neighbours.build_index(docs), F.expr("vec_id % 50 = 0")).collect()
    got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert {r["query_id"] for r in found} == {0, 50}
    assert got[0] == [1, 2, 3, 4, 5]  # ties to the smaller id; its own repeated row is no candidate
    assert got[50][:2] == [None, 51] and len(got[50]) == 5
    few = neighbours.search(neighbours.build_index(docs.filter("vec_id IN (50, 51)")), F.expr("vec_id % 50 = 0")).collect()
    assert [tuple(r)[:3] for r in few] == [(50, 1, 51)]
    assert neighbours.search(neighbours.build_index(docs.limit(0)), F.expr("vec_id % 50 = 0")).count() == 0


def test_products_from_bit_planes():
    rng = np.random.default_rng(2)
    for n in (1, 7, 64, 65, 200):
        unit, codes = rng.normal(size=(9, n)), rng.integers(0, 2, (13, n)).astype(np.uint8)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        rounded = neighbours.planes(unit)
        values = rounded.low[:, None] + rounded.step[:, None] * np.rint((unit - rounded.low[:, None]) / rounded.step[:, None])
        want = (rounded.scale[:, None] * values) @ (2.0 * codes.T - 1)
        words = neighbours._words(np.packbits(codes, axis=1))
        got = rounded.products(slice(None), words, codes.sum(axis=1, dtype=np.int64))
        assert np.abs(got - want).max() < 1e-4
        assert np.allclose(np.linalg.norm(unit - rounded.scale[:, None] * values, axis=1), rounded.missed)


def test_many_blocks_of_queries(spark, monkeypatch):
    prepared(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = neighbours.build_index(docs)
    asked = F.expr("vec_id % 10 = 0")
    one = sorted(map(tuple, neighbours.search(index, asked, bound=9.0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    assert sorted(map(tuple, neighbours.search(index, asked, bound=9.0).collect())) == one


def test_few_dimensions_and_one(spark):
    prepared(spark)
    docs = spark.createDataFrame([(0, [3.0]), (1, [-1.0]), (2, [5.0])], "vec_id bigint, embedding array<float>")
    rows = neighbours.search(neighbours.build_index(docs), F.expr("vec_id = 0")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(2, 1.0), (1, -1.0)]
