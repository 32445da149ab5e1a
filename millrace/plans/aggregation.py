"""Aggregation."""

from functools import reduce

from pyspark.sql import functions as F

from millrace.operators import aggregates
from millrace.plans.registry import query
from millrace.workdir import materialise


@query(
    "agg_group_by",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
              round(sum(l_extendedprice), 2) AS sum_base_price,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
              round(avg(l_quantity), 6) AS avg_qty, min(l_tax) AS min_tax, max(l_tax) AS max_tax,
              count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
       GROUP BY l_returnflag, l_linestatus""",
)
def agg_group_by(t):
    shipped = F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")
    price = F.col("l_extendedprice")
    return (
        t.lineitem.filter(shipped)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.min("l_tax").alias("min_tax"),
            F.max("l_tax").alias("max_tax"),
            F.count("*").alias("count_order"),
        )
    )


@query(
    "agg_global",
    """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest
       FROM orders HAVING count(*) > 0""",
)
def agg_global(t):
    return t.orders.agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_totalprice").alias("largest"),
    ).filter(F.col("n") > 0)


@query(
    "agg_having",
    """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10""",
)
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(F.col("n") > 10)


@query(
    "agg_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
              CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_numbers,
              count(DISTINCT (l_suppkey, l_linenumber)) AS pairs
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.sum_distinct("l_linenumber").alias("line_numbers"),
        F.count_distinct("l_suppkey", "l_linenumber").alias("pairs"),
    )


@query(
    "agg_distinct_states",
    """SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts,
              count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders
       FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def agg_distinct_states(t):
    """Every level of the rollup is counted from one written table of states."""
    keys, names = ["l_returnflag", "l_linestatus"], ["parts", "suppliers", "orders"]
    states = aggregates.distinct_states(t.lineitem, keys, ["l_partkey", "l_suppkey", "l_orderkey"])
    states = materialise(states, "distinct-states")
    levels = [aggregates.distinct_counts(states, keys[:n], names) for n in range(len(keys), -1, -1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


@query(
    "agg_rollup",
    """SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS TINYINT) AS status_rolled,
              count(*) AS n, sum(l_quantity) AS quantity
       FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def agg_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.grouping("l_linestatus").alias("status_rolled"),
        F.count("*").alias("n"),
        F.sum("l_quantity").alias("quantity"),
    )


@query(
    "agg_cube",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS largest
       FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def agg_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("largest")
    )


@query(
    "agg_grouping_sets",
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())""",
)
def agg_grouping_sets(t):
    flag, status, number = (F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber"))
    return (
        t.lineitem.groupingSets([[flag, status], [number], []], flag, status, number)
        .agg(F.count("*").alias("n"))
        .select("l_returnflag", "l_linestatus", "l_linenumber", "n")
    )


@query(
    "agg_first_last",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type,
              arg_max(event_type, (ts, event_id)) AS last_type,
              arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase
       FROM events GROUP BY user_id""",
)
def agg_first_last(t):
    order = [F.col("ts"), F.col("event_id")]
    kind = F.col("event_type")
    spent = F.when(kind == "purchase", F.col("value"))
    return t.events.groupBy("user_id").agg(
        aggregates.first(kind, order).alias("first_type"),
        aggregates.last(kind, order).alias("last_type"),
        aggregates.first(spent, order, ignore_nulls=True).alias("first_purchase"),
    )
