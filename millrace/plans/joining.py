"""Joins."""

from pyspark.sql import functions as F

from millrace.operators import joins, skew
from millrace.plans.registry import query
from millrace.workdir import materialise


@query(
    "join_inner",
    """SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", "o_totalprice"
    )


@query(
    "join_theta",
    """WITH months AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS first FROM orders)
       SELECT strftime(first, '%Y-%m') AS month, count(*) AS shipped
       FROM lineitem JOIN months ON l_shipdate >= first AND l_shipdate < first + INTERVAL 1 MONTH
       GROUP BY first""",
)
def join_theta(t):
    first = F.date_trunc("month", "o_orderdate").cast("date")
    months = t.orders.select(first.alias("first")).distinct().select(
        F.date_format("first", "yyyy-MM").alias("month"),
        F.unix_date("first").alias("low"),
        F.unix_date(F.add_months("first", 1)).alias("high"),
    )
    months = materialise(months, "months")
    # Lines of one day fall in the same range: they are counted before they join.
    day = F.unix_date(F.col("l_shipdate").cast("date")).alias("day")
    per_day = t.lineitem.groupBy(day).agg(F.count("*").alias("n"))
    return (
        joins.in_range(per_day, "day", months, "low", "high")
        .groupBy("month")
        .agg(F.sum("n").alias("shipped"))
    )


@query(
    "join_theta_ranges",
    """WITH spans AS (
         SELECT o_orderkey AS low, o_orderkey + 1 + CAST(pow(10, o_orderkey % 10) AS BIGINT) AS high, o_orderkey % 10 AS digits
         FROM orders WHERE o_orderkey % 49 = 0)
       SELECT o_orderkey, count(*) AS spans, max(digits) AS longest, min(low) AS first
       FROM orders JOIN spans ON o_orderkey >= low AND o_orderkey < high GROUP BY o_orderkey""",
)
def join_theta_ranges(t):
    # Ranges of one to 10^9 keys: no width of buckets suits them all.
    key = F.col("o_orderkey")
    length = F.pow(F.lit(10), key % 10).cast("bigint")
    spans = t.orders.filter("o_orderkey % 49 = 0").select(
        key.alias("low"), (key + 1 + length).alias("high"), (key % 10).alias("digits")
    )
    # The long ones hold most of the keys: spans are merged before they meet a key.
    merged = {"spans": (F.lit(1).cast("bigint"), F.sum), "longest": (F.col("digits"), F.max), "first": (F.col("low"), F.min)}
    found = joins.in_range(t.orders.select("o_orderkey"), "o_orderkey", spans, "low", "high", merged=merged)
    return found.groupBy("o_orderkey").agg(
        F.sum("spans").alias("spans"), F.max("longest").alias("longest"), F.min("first").alias("first")
    )


@query(
    "join_theta_residual",
    """SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem
       ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity * 10000 > o_totalprice""",
)
def join_theta_residual(t):
    condition = (
        (F.col("o_orderkey") == F.col("l_orderkey"))
        & (F.col("l_shipdate") > F.col("o_orderdate"))
        & (F.col("l_quantity") * 10000 > F.col("o_totalprice"))
    )
    return t.orders.join(t.lineitem, condition).select("o_orderkey", "l_linenumber", "l_quantity")


@query(
    "join_left",
    """SELECT c_custkey, o_orderkey FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000""",
)
def join_left(t):
    big = t.orders.filter(F.col("o_totalprice") > 300000)
    return joins.outer(t.customer, big, {"c_custkey": "o_custkey"}, "left").select(
        "c_custkey", "o_orderkey"
    )


@query(
    "join_right",
    """SELECT l_linenumber, p_partkey, p_name FROM
       (SELECT * FROM lineitem WHERE l_quantity > 48) l RIGHT JOIN part ON l_partkey = p_partkey""",
)
def join_right(t):
    bulk = t.lineitem.filter(F.col("l_quantity") > 48)
    return joins.outer(bulk, t.part, {"l_partkey": "p_partkey"}, "right").select(
        "l_linenumber", "p_partkey", "p_name"
    )


@query(
    "join_full",
    """SELECT coalesce(a.custkey, b.custkey) AS custkey, a.balance, b.orderkey
       FROM (SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000) a
       FULL JOIN (SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders
                  WHERE o_orderstatus = 'F') b ON a.custkey = b.custkey""",
)
def join_full(t):
    rich = t.customer.filter(F.col("c_acctbal") > 5000).select(
        F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance")
    )
    done = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey")
    )
    return joins.full_using(rich, done, ["custkey"])


@query(
    "join_semi",
    """SELECT s_suppkey, s_name FROM supplier
       SEMI JOIN (SELECT * FROM lineitem WHERE l_discount > 0.08) l ON s_suppkey = l_suppkey""",
)
def join_semi(t):
    # Distinct keys first: the discounted lines shrink map-side before they move.
    discounted = t.lineitem.filter(F.col("l_discount") > 0.08).select("l_suppkey").distinct()
    return t.supplier.join(discounted, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(
        "s_suppkey", "s_name"
    )


@query(
    "join_anti",
    """SELECT p_partkey, p_name FROM part
       ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey""",
)
def join_anti(t):
    bulk = t.lineitem.filter(F.col("l_quantity") > 45).select("l_partkey").distinct()
    return t.part.join(bulk, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(
        "p_partkey", "p_name"
    )


@query(
    "join_cross",
    """SELECT c_custkey, r_name, c_nationkey % 5 = r_regionkey AS hit FROM customer CROSS JOIN region""",
)
def join_cross(t):
    return joins.cross(t.customer, t.region).select(
        "c_custkey", "r_name", (F.col("c_nationkey") % 5 == F.col("r_regionkey")).alias("hit")
    )


@query(
    "join_using",
    """SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)""",
)
def join_using(t):
    return t.documents.join(t.labels, ["doc_id"]).select("doc_id", "quality", "n_chars")


@query(
    "join_natural",
    """SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels""",
)
def join_natural(t):
    return natural(t.documents.select("doc_id", "lang"), t.labels).select("doc_id", "lang", "toxic")


def natural(left, right, how="inner"):
    """``left NATURAL how JOIN right``: on every column both sides have."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("natural join without a common column")
    return left.join(right, shared, how)


@query(
    "join_broadcast_hint",
    """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name""",
)
def join_broadcast_hint(t):
    nation = skew.broadcast_if_small(t.nation)
    return (
        t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n"))
    )


@query(
    "join_merge_hint",
    """SELECT o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       GROUP BY o_orderpriority""",
)
def join_merge_hint(t):
    return (
        t.orders.join(t.lineitem.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("lines"))
    )


@query(
    "join_shuffle_hash_hint",
    """SELECT s_nationkey, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       GROUP BY s_nationkey""",
)
def join_shuffle_hash_hint(t):
    # Suppliers are hashed partition by partition, so the lines need no sort.
    suppliers = t.supplier.hint("shuffle_hash")
    return (
        t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey")
        .agg(F.count("*").alias("lines"))
    )


@query("hint_rebalance", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def hint_rebalance(t):
    # Like DISTRIBUTE BY, but partitions of one size come first: AQE splits large ones.
    return t.orders.hint("rebalance", "o_custkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "top_unshipped_orders",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
              strftime(o_orderdate, '%Y-%m-%d') AS orderdate, o_orderpriority
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
         AND l_shipdate > TIMESTAMP '1998-03-15'
       GROUP BY l_orderkey, o_orderdate, o_orderpriority
       ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
def top_unshipped_orders(t):
    """Flagship: the open orders of one market segment with the most revenue."""
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    segment = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    placed = t.orders.filter(F.col("o_orderdate") < day)
    open_lines = t.lineitem.filter(F.col("l_shipdate") > day)
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        placed.join(segment, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .join(open_lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("l_orderkey", "o_orderdate", "o_orderpriority")
        .agg(F.round(revenue, 2).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "l_orderkey")
        .limit(10)
        .select(
            "l_orderkey",
            "revenue",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderdate"),
            "o_orderpriority",
        )
    )
