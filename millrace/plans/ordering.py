"""Sort, limit and distribution."""

from pyspark.sql import functions as F

from millrace.operators import placing
from millrace.plans.registry import query


@query(
    "order_by",
    """SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
       ORDER BY quality DESC NULLS LAST, toxic ASC NULLS FIRST, doc_id""",
)
def order_by(t):
    return (
        t.documents.select("doc_id")
        .join(t.labels, "doc_id", "left")
        .orderBy(F.desc_nulls_last("quality"), F.asc_nulls_first("toxic"), "doc_id")
        .select("doc_id", "quality", "toxic")
    )


@query("sort_by", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_by(t):
    return placing.sort_within(
        t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")]
    )


@query("distribute_by", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem")
def distribute_by(t):
    return placing.distribute(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"])


@query("cluster_by", "SELECT user_id, event_id, event_type FROM events")
def cluster_by(t):
    return placing.cluster(t.events.select("user_id", "event_id", "event_type"), ["user_id"])


@query(
    "limit_topk",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
)
def limit_topk(t):
    return (
        t.customer.select("c_custkey", "c_acctbal")
        .orderBy(F.desc("c_acctbal"), F.asc("c_custkey"))
        .limit(25)
    )
