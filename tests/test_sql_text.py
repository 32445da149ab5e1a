"""The same operators as SQL text over registered tables, as users send it.

Spark's own parser takes the statements; each is compared with the registered
query that says the same with the DataFrame API.
"""

import pytest

import __spark_entry__ as contract
from millrace.sources.tables import Tables

SF_DIR = "/root/testdata/sf0.001"
QUERIES = contract.queries()

STATEMENTS = {
    "table_stmt": "TABLE customer",
    "scan_table": """SELECT o.k AS orderkey, o.cust AS custkey, o.status FROM
        (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders) AS o(k, cust, status)""",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "filter_where": """SELECT o_orderkey, o_totalprice FROM orders
        WHERE (o_orderstatus == 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '5-LOW'""",
    "filter_like_rlike": """SELECT p_partkey, p_name FROM part
        WHERE (p_name LIKE '%ring' OR p_name RLIKE '^(red|blue) w') AND p_name NOT LIKE 's_all%'
        AND p_brand NOT REGEXP '#1[0-9]$'""",
    "filter_null_distinct": """SELECT doc_id, quality, quality IS NULL AS unlabelled,
        quality IS DISTINCT FROM 1 AS not_good, quality <=> toxic AS same
        FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR quality IS NOT NULL""",
    "compare_ops": """SELECT l_orderkey, l_quantity = 10 AS eq, l_quantity <> 10 AS ne,
        l_quantity < 10 AS lt, l_quantity !> 10 AS not_gt, l_quantity > 10 AS gt,
        l_quantity !< 10 AS not_lt, l_returnflag <=> 'A' AS flag_a FROM lineitem""",
    "case_when": """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large'
        WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders""",
    "subquery_in": """SELECT c_custkey, 'in' AS side FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
        UNION ALL SELECT c_custkey, 'not in' FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
    "subquery_exists": """SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS
        (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate
         AND l_returnflag = 'R')""",
    "subquery_scalar": """SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above,
        (SELECT max(s_acctbal) FROM supplier) AS richest FROM customer
        WHERE c_acctbal < (SELECT max(s_acctbal) FROM supplier)""",
    "cte": """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
        big AS (SELECT * FROM spend WHERE total > 1000000)
        SELECT c_mktsegment, count(*) AS n FROM customer JOIN big ON c_custkey = o_custkey
        GROUP BY c_mktsegment""",
    "join_semi": """SELECT s_suppkey, s_name FROM supplier LEFT SEMI JOIN lineitem
        ON s_suppkey = l_suppkey AND l_discount > 0.08""",
    "join_anti": """SELECT p_partkey, p_name FROM part ANTI JOIN lineitem
        ON p_partkey = l_partkey AND l_quantity > 45""",
    "join_cross": """SELECT c_custkey, r_name, c_nationkey % 5 = r_regionkey AS hit
        FROM customer, region""",
    "join_natural": "SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels",
    "join_broadcast_hint": """SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "join_merge_hint": """SELECT /*+ MERGE(lineitem) */ o_orderpriority, count(*) AS lines
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    "join_shuffle_hash_hint": """SELECT /*+ SHUFFLE_HASH(supplier) */ s_nationkey, count(*) AS lines
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""",
    "hint_rebalance": """SELECT /*+ REBALANCE(o_custkey) */ o_custkey, o_orderkey, o_orderstatus
        FROM orders""",
    "join_full": """SELECT custkey, balance, orderkey FROM
        (SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000)
        FULL OUTER JOIN (SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders
        WHERE o_orderstatus = 'F') USING (custkey)""",
    "agg_rollup": """SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS status_rolled,
        count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
        GROUP BY l_returnflag, l_linestatus WITH ROLLUP""",
    "agg_cube": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS largest
        FROM orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE""",
    "agg_grouping_sets": """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
        GROUP BY l_returnflag, l_linestatus, l_linenumber
        GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())""",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 10",
    "agg_distinct": """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
        sum(DISTINCT l_linenumber) AS line_numbers, count(DISTINCT l_suppkey, l_linenumber) AS pairs
        FROM lineitem GROUP BY l_returnflag""",
    "window_named": """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS nth,
        count(*) OVER (PARTITION BY o_custkey) AS orders,
        o_totalprice - lag(o_totalprice, 1, o_totalprice) OVER w AS change FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "window_distribute_sort": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
        CAST(dense_rank() OVER (DISTRIBUTE BY l_suppkey SORT BY l_quantity) AS BIGINT) AS place,
        count(*) OVER (CLUSTER BY l_suppkey) AS lines FROM lineitem""",
    "distribute_by": "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem DISTRIBUTE BY l_suppkey",
    "cluster_by": "SELECT user_id, event_id, event_type FROM events CLUSTER BY user_id",
    "sort_by": "SELECT o_orderkey, o_totalprice FROM orders SORT BY o_totalprice DESC, o_orderkey",
    "limit_topk": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    "intersect_all": """SELECT c_nationkey AS nationkey FROM customer
        INTERSECT ALL SELECT s_nationkey FROM supplier""",
    "except_all": "SELECT c_nationkey AS nationkey FROM customer MINUS ALL SELECT s_nationkey FROM supplier",
    "lateral_view": """SELECT doc_id, pos, word FROM documents
        LATERAL VIEW posexplode(split(text, ' ', -1)) w AS pos, word""",
    "lateral_view_outer": """SELECT c_custkey, nation_letter FROM customer LATERAL VIEW OUTER
        explode(IF(c_acctbal < 0, CAST(array() AS array<string>), split(c_mktsegment, 'I', -1)))
        p AS nation_letter""",
    "arith_ops": """SELECT l_orderkey, l_quantity + 1 AS plus, l_quantity - 1 AS minus,
        l_quantity * l_tax AS times, l_extendedprice / l_quantity AS over, l_linenumber % 3 AS rem,
        -l_linenumber AS neg, +l_linenumber AS pos,
        try_divide(l_quantity, l_linenumber - 1) AS guarded FROM lineitem""",
    "bitwise_ops": """SELECT o_orderkey, o_orderkey & o_custkey AS both, o_orderkey | o_custkey AS either,
        o_orderkey ^ o_custkey AS one, ~o_orderkey AS flipped FROM orders""",
    "str_concat": "SELECT p_partkey, p_brand || '/' || p_name || ' ' || p_size AS label FROM part",
    "str_position": "SELECT doc_id, POSITION('the' IN text) AS at FROM documents",
    "struct_ops": """SELECT c_custkey, s.name, s.place.nation, s.place.balance > 0 AS solvent FROM
        (SELECT c_custkey, STRUCT(c_name AS name, STRUCT(c_nationkey AS nation, c_acctbal AS balance) AS place)
         AS s FROM customer) WHERE (c_custkey, s.place.nation) <> (1L, 1)""",
}


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_text_equals_dataframe(spark, key):
    Tables(spark, SF_DIR).register()
    text, frame = spark.sql(STATEMENTS[key]), QUERIES[key](spark, SF_DIR)
    columns = sorted(frame.columns)
    assert sorted(text.columns) == columns
    text, frame = text.select(*columns), frame.select(*columns)
    assert text.exceptAll(frame).isEmpty() and frame.exceptAll(text).isEmpty()


def test_chained_set_operations_differ_from_text(spark):
    """In SQL text INTERSECT binds tighter; ``sets.Chain`` applies left to right."""
    text = "SELECT 1 AS v UNION SELECT 2 INTERSECT SELECT 2 "
    assert sorted(r.v for r in spark.sql(text).collect()) == [1, 2]
