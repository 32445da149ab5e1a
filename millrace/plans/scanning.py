"""Scans and inline sources."""

from pyspark.sql import functions as F

from millrace.plans.registry import query


@query(
    "scan_table",
    """SELECT k AS orderkey, cust AS custkey, status
       FROM (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status FROM orders) o""",
)
def scan_table(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").toDF("k", "cust", "status")
    o = o.alias("o")
    return o.select(
        F.col("o.k").alias("orderkey"), F.col("o.cust").alias("custkey"), F.col("o.status")
    )


@query("table_stmt", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def table_stmt(t):
    return t.spark.sql(f"TABLE {t.view('customer', 'millrace_customer')}")


@query(
    "inline_values",
    """SELECT v.priority_group, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN (VALUES ('1-URGENT', 'rush'), ('2-HIGH', 'rush'), ('3-MEDIUM', 'normal'),
            ('4-NOT SPECIFIED', 'normal'), ('5-LOW', 'late')) AS v(priority, priority_group)
         ON o_orderpriority = v.priority
       GROUP BY v.priority_group""",
)
def inline_values(t):
    groups = t.spark.sql(
        """VALUES ('1-URGENT', 'rush'), ('2-HIGH', 'rush'), ('3-MEDIUM', 'normal'),
           ('4-NOT SPECIFIED', 'normal'), ('5-LOW', 'late') AS v(priority, priority_group)"""
    )
    return (
        t.orders.join(groups, F.col("o_orderpriority") == F.col("priority"))
        .groupBy("priority_group")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "tvf_range",
    """SELECT CAST(h AS BIGINT) AS hour, coalesce(n, 0) AS n
       FROM range(0, 24) AS r(h)
       LEFT JOIN (SELECT hour(ts) AS eh, count(*) AS n FROM events GROUP BY 1) e ON e.eh = r.h""",
)
def tvf_range(t):
    hours = t.spark.tvf.range(0, 24).toDF("hour")
    seen = t.events.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "from_first",
    """SELECT s_suppkey, s_name, s_acctbal, true AS projected FROM supplier WHERE s_acctbal > 0
       UNION ALL
       SELECT s_suppkey, s_name, s_acctbal, false AS projected FROM supplier""",
)
def from_first(t):
    name = t.view("supplier", "millrace_supplier")
    picked = t.spark.sql(
        f"FROM {name} SELECT s_suppkey, s_name, s_acctbal, true AS projected WHERE s_acctbal > 0"
    )
    bare = t.spark.sql(f"FROM {name}").select(
        "s_suppkey", "s_name", "s_acctbal", F.lit(False).alias("projected")
    )
    return picked.unionAll(bare)


@query(
    "parquet_pushdown",
    """SELECT l_orderkey, l_quantity FROM lineitem
       WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1998-01-01'""",
)
def parquet_pushdown(t):
    # Both predicates and the three columns reach the scan.
    return t.lineitem.filter(
        (F.col("l_quantity") >= 45)
        & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    ).select("l_orderkey", "l_quantity")
