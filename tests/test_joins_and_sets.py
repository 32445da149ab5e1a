import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, sets
from millrace.plans.joining import natural


def ints(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


@pytest.mark.parametrize(
    "left,values,want",
    [
        ([1, 2, None], [2, 3], [1]),
        ([1, 2, None], [2, None], []),
        ([1, 2, None], [None], []),
        ([1, 2, None], [], [1, 2, None]),
        ([], [1], []),
    ],
)
def test_not_in_follows_three_valued_logic(spark, rows, left, values, want):
    found = joins.not_in(ints(spark, "a", left), "a", ints(spark, "b", values))
    assert rows(found) == sorted([(w,) for w in want], key=lambda r: (r[0] is not None, r[0]))


def test_not_in_does_not_broadcast_the_subquery(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.not_in(spark.range(50).toDF("a"), "a", spark.range(20).toDF("b"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
        assert found.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [1000, 3])
def test_full_join_with_and_without_hot_keys(spark, rows, limit):
    left = spark.createDataFrame(
        [("k", i) for i in range(6)] + [(None, 7), ("l", 8)], "key string, a long"
    )
    right = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), ("r", 4)], "key string, b long")
    want = rows(left.join(right, "key", "full"))
    assert rows(joins.full_using(left, right, ["key"], limit), "key", "a", "b") == want
    assert len(want) == 12 + 4


@pytest.mark.parametrize("limit", [1000, 3])
@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_with_and_without_hot_keys(spark, rows, how, limit):
    left = spark.createDataFrame(
        [("k", i) for i in range(6)] + [(None, 7), ("l", 8)], "lk string, a long"
    )
    right = spark.createDataFrame(
        [("k", i) for i in range(5)] + [(None, 3), ("r", 4)], "rk string, b long"
    )
    want = rows(left.join(right, left["lk"] == right["rk"], how))
    found = joins.outer(left, right, {"lk": "rk"}, how, limit)
    assert rows(found, "lk", "a", "rk", "b") == want


def test_cross(spark):
    left, right = spark.range(5).toDF("a"), spark.range(4).toDF("b")
    for bound in (4, 3):
        assert joins.cross(left, right, bound).distinct().count() == 20


def test_in_range_edges(spark, rows):
    points = spark.createDataFrame([(v,) for v in (-11, -10, -1, 0, 9, 10, 25)], "at long")
    ranges = spark.createDataFrame(
        [("neg", -10, 0), ("one", 0, 10), ("wide", -100, 100), ("empty", 5, 5), ("late", 25, 26)],
        "name string, low long, high long",
    )
    spans = [tuple(r) for r in ranges.collect()]
    want = sorted((p.at, n) for p in points.collect() for n, lo, hi in spans if lo <= p.at < hi)
    for bits in (1, 2, 4):
        assert rows(joins.in_range(points, "at", ranges, "low", "high", bits), "at", "name") == want
    assert joins.in_range(points, "at", ranges.limit(0), "low", "high").count() == 0
    assert joins.in_range(points, "at", ranges, "low", "high").select("low", "high").dtypes == ranges.select("low", "high").dtypes


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_ranges_of_very_different_length(spark, rows, bits):
    """From 1 to 10^9 and around zero: every pair once, and a number of rows that only the logarithm sets."""
    rng = random.Random(bits)
    spans = [(k, low, low + rng.choice([1, 2, 3, 10, 1000, 10**6, 10**9, 4 ** (k % 28)])) for k in range(40) for low in [rng.randint(-(10**9), 10**9)]]
    spans += [(40, -(1 << 60), 1 << 60), (41, 0, 1 << 61), (42, -5, -5), (43, 7, 3)]
    ends = [v + d for _, a, b in spans for v in (a, b) for d in (-1, 0, 1)]
    points = spark.createDataFrame([(v,) for v in {*ends, 0, -1, *(rng.randint(-(10**9), 10**9) for _ in range(200))}], "at long")
    ranges = spark.createDataFrame(spans, "name long, low long, high long")
    want = sorted((p.at, n) for p in points.collect() for n, lo, hi in spans if lo <= p.at < hi)
    assert rows(joins.in_range(points, "at", ranges, "low", "high", bits), "at", "name") == want
    nodes = joins.range_nodes(ranges, "low", "high", bits).groupBy("name").count().agg(F.max("count")).first()[0]
    assert nodes <= 2 * (2**bits - 1) * (62 // bits + 1)


def test_merged_ranges_make_no_pairs(spark, rows):
    """A point comes once, whatever the number of ranges around it, with what all of them add up to."""
    rng = random.Random(5)
    lows = [rng.randint(-500, 500) for _ in range(300)]
    spans = [(low, low + rng.choice([-1, 0, 1, 5, 64, 100, 10**9]), k) for k, low in enumerate(lows)] + [(None, 5, 1), (5, None, 2)]
    values = [rng.randint(-600, 1500) for _ in range(400)] + [None, 10**9, -(10**9), 0, 63, 64, 64]
    points = spark.createDataFrame([(v,) for v in values], "at int")
    ranges = spark.createDataFrame(spans, "low long, high long, k long")
    merged = {"n": (F.lit(1), F.sum), "most": (F.col("k"), F.max), "first": (F.col("low"), F.min)}
    whole = [s for s in spans if None not in s]
    around = [(v, [s for s in whole if s[0] <= v < s[1]]) for v in values if v is not None]
    want = sorted((v, len(a), max(k for *_, k in a), min(low for low, *_ in a)) for v, a in around if a)
    assert sum(len(a) for _, a in around) > 20 * len(want)
    for bits in (1, 2, 4):
        assert rows(joins.in_range(points, "at", ranges, "low", "high", bits, merged)) == want
    assert joins.in_range(points, "at", ranges.limit(0), "low", "high", merged=merged).count() == 0


def test_subquery_is_computed_once(spark):
    values = joins.distinct_values(spark.range(20).select((F.col("id") % 7).alias("v")))
    left = spark.range(50).toDF("a")
    both = joins.is_in(left, "a", values).unionAll(joins.not_in(left, "a", values))
    assert both.count() == 50 and joins.is_in(left, "a", values).count() == 7
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "NestedLoop" not in plan


def test_in_range_joins_on_a_key(spark):
    points = spark.range(100).toDF("at")
    ranges = spark.createDataFrame([(0, 5)], "low long, high long")
    plan = joins.in_range(points, "at", ranges, "low", "high")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_natural_join(spark, rows):
    a = spark.createDataFrame([(1, "x", 5)], "k long, s string, a long")
    b = spark.createDataFrame([(1, "x", 6), (1, "y", 7)], "k long, s string, b long")
    assert rows(natural(a, b)) == [(1, "x", 5, 6)]
    with pytest.raises(ValueError):
        natural(a.select("a"), b.select("b"))


A, B, C = [1, 1, 1, 2, 3, None, None], [1, 1, 3, 4, None], [3, 4]


def test_set_operations_on_repeats_and_nulls(spark):
    a, b = ints(spark, "v", A), ints(spark, "v", B)

    def bag(df):
        return Counter(r[0] for r in df.collect())

    assert bag(sets.union_distinct(a, b)) == Counter({1, 2, 3, 4, None})
    assert bag(sets.intersect(a, b)) == Counter({1, 3, None})
    assert bag(sets.except_(a, b)) == Counter({2})
    for limit in (1000, 2, 1):
        assert bag(sets.intersect_all(a, b, limit)) == Counter(A) & Counter(B)
        assert bag(sets.except_all(a, b, limit)) == Counter(A) - Counter(B)


def test_chain_goes_left_to_right(spark, rows):
    a, b, c = (ints(spark, "v", v) for v in (A, B, C))
    # SQL text would intersect b and c first and keep 1, 2 and null of a.
    assert rows(sets.Chain(a).union(b).intersect(c).df) == [(3,), (4,)]
    assert rows(sets.Chain(a).union_all(b).except_all(c).intersect_all(a).df) == rows(
        ints(spark, "v", [1, 1, 1, 2, 3, None, None])
    )
    assert rows(sets.Chain(a).except_(c).df) == [(None,), (1,), (2,)]


def test_intersect_shrinks_before_it_shuffles(spark):
    a = spark.range(100).select((F.col("id") % 3).alias("v"))
    b = spark.range(100).select((F.col("id") % 5).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sets.intersect(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Every exchange sits on top of a partial aggregate.
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges and all("HashAggregate" in lines[i + 1] for i in exchanges)
