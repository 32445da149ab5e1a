"""Distinct counts from states that merge, against Spark's own."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace import workdir
from millrace.operators import aggregates
from tests.plans import physical


def test_states_count_and_merge(spark, rows):
    values = [0, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), 5, 5, None]
    data = [(k, v, 1) for k in ("a", None) for v in values] + [("only nulls", None, None)]
    df = spark.createDataFrame(data, "k string, x bigint, y int")
    want = df.groupBy("k").agg(F.count_distinct("x").alias("n"), F.count_distinct("y").alias("m"))
    states = aggregates.distinct_states(df, ["k"], ["x", "y"])
    assert rows(aggregates.distinct_counts(states, ["k"], ["n", "m"])) == rows(want)
    more = spark.createDataFrame([("a", 5, 2), ("b", 7, 1)], df.schema)
    both = states.unionByName(aggregates.distinct_states(more, ["k"], ["x", "y"]))
    every = df.unionAll(more)
    assert rows(aggregates.distinct_counts(both, ["k"], ["n", "m"])) == rows(
        every.groupBy("k").agg(F.count_distinct("x"), F.count_distinct("y"))
    )
    assert rows(aggregates.distinct_counts(both, [], ["n", "m"])) == rows(every.agg(F.count_distinct("x"), F.count_distinct("y")))
    assert aggregates.distinct_counts(aggregates.distinct_states(df.limit(0), ["k"], ["x"]), ["k"], ["n"]).count() == 0


def test_no_expand_and_hash_aggregates_alone(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    states = aggregates.distinct_states(lines, ["l_returnflag"], ["l_partkey", "l_suppkey"])
    plan = physical(aggregates.distinct_counts(states, ["l_returnflag"], ["parts", "suppliers"]))
    assert "Expand" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
