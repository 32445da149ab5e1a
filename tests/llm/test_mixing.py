"""Mixing to target weights (operator 5): flow against enumeration, quotas, choice of documents."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace.llm import mixing
from millrace.llm.flow import route
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.01"


def test_flow_meets_what_can_be_met_at_the_least_cost():
    rng = random.Random(2)
    for _ in range(60):
        patterns = {p: rng.randint(0, 3) for p in [("a",), ("b",), ("a", "b")]}
        quotas = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        given = route(patterns, quotas, 2)
        cost = lambda taken: sum(max(0, taken[p] - patterns[p]) for p in patterns)
        met = lambda s: sum(g.get(s, 0) for g in given.values())
        options = []
        caps = [2 * patterns[p] for p in patterns]
        for a, b, x, y in itertools.product(*(range(c + 1) for c in (caps[0], caps[1], caps[2], caps[2]))):
            if x + y <= caps[2] and a + x <= quotas["a"] and b + y <= quotas["b"]:
                options.append((-(a + b + x + y), cost({("a",): a, ("b",): b, ("a", "b"): x + y})))
        taken = {p: sum(g.values()) for p, g in given.items()}
        assert (-met("a") - met("b"), cost(taken)) == min(options)
        assert all(met(s) <= quotas[s] for s in quotas)


def test_targets_are_dealt_again_until_none_is_above():
    sizes = {"a": 10, "b": 100, None: 1, "c": 0}
    target = mixing.capped_targets(sizes)
    # a weighs 5, b 2, c 1 and null 5: a, c and null are at twice their size, and b has the rest.
    assert target == {"a": 20.0, "c": 0.0, None: 2.0, "b": pytest.approx(1.5 * 111 - 22)}
    assert mixing.capped_targets({}) == {} and mixing.capped_targets({"a": 0}) == {"a": 0.0}


def naive_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, source_of):
    sizes, taken = {}, {}
    for r in rows:
        s = source_of[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    target = mixing.capped_targets(sizes)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], rel=1e-12)
    longest = {s: max((r["size"] for r in rows if source_of[r["doc_id"]] == s), default=0) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


def test_query_meets_its_targets_and_repeats_itself(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    query = contract.queries()["op5_mixing"]
    rows = query(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == naive_size(docs[r["doc_id"]]["text"]) for r in rows)
    check(rows, {d: r["source"] for d, r in docs.items()})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, query(spark, SF_DIR).collect()))


def test_one_source_holds_most_rows(spark):
    prepared(spark)
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', int(1 + id % 9)) AS text", "if(id % 3 = 0, concat('s', id % 7), 'hot') AS source"
    )
    rows = mixing.mix(docs, F.array("source")).collect()
    check(rows, {r["doc_id"]: r["source"] for r in docs.collect()})


def test_overlapping_sources(spark):
    prepared(spark)
    docs = spark.range(900).selectExpr("id AS doc_id", "'a b c' AS text", "array('all', concat('s', id % 3)) AS belongs")
    rows = mixing.mix(docs, F.col("belongs"), quotas=lambda sizes: {"s0": 600, "s1": 300, "all": 1200, "s2": 0}).collect()
    total = {}
    for r in rows:
        total[r["pattern"][1]] = total.get(r["pattern"][1], 0) + r["taken"]
    assert abs(sum(total.values()) - 2100) <= 3
    assert total["s0"] >= 600 - 3 and total["s1"] >= 300 - 3 and max(total.values()) <= 1800


def test_odd_documents(spark):
    prepared(spark)
    rows = mixing.mix(odd_docs(spark), F.array("source")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted((d or 0, naive_size(t)) for d, t in TEXTS)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(no_docs(spark), F.array("source")).count() == 0


def test_equal_rows_at_the_cut(spark):
    """As many of the rows alike come in as end nearest to the target, however many there are."""
    prepared(spark)
    for n in (1, 2, 3, 10, 31):
        docs = spark.createDataFrame([(None, "one two three", "a")] * n + [(9, "four five", None)], "doc_id bigint, text string, source string").repartition(5)
        mixed = mixing.mix(docs, F.array("source")).collect()
        for s, size in (("a", 3), (None, 2)):
            own = [r for r in mixed if r["pattern"] == [s]]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size / 2 + 1
            assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
        assert sorted((r["doc_id"] or 0, r["copies"]) for r in mixed) == sorted((r["doc_id"] or 0, r["copies"]) for r in mixing.mix(docs, F.array("source")).collect())
