"""Projection, filters, predicates, subqueries, set operations, generators."""

from pyspark.sql import functions as F

from millrace.functions import user_defined
from millrace.operators import joins, sampling, sets
from millrace.plans.registry import query

# --- projection -------------------------------------------------------------------


@query(
    "project_alias",
    """SELECT o_orderkey AS id, o_totalprice * 2 AS doubled, upper(o_orderstatus) AS status
       FROM orders""",
)
def project_alias(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") * 2).alias("doubled"),
        F.upper("o_orderstatus").alias("status"),
    )


@query("project_star", "SELECT s.*, n_name FROM supplier s JOIN nation ON s_nationkey = n_nationkey")
def project_star(t):
    s = t.supplier.alias("s")
    return s.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s.*", "n_name")


@query("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def select_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# --- filters ----------------------------------------------------------------------


@query(
    "filter_where",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '5-LOW'""",
)
def filter_where(t):
    return t.orders.filter(
        ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300000))
        & ~(F.col("o_orderpriority") == "5-LOW")
    ).select("o_orderkey", "o_totalprice")


@query(
    "filter_between_in",
    """SELECT p_partkey, p_size, p_type FROM part
       WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'SMALL', 'PROMO')
         AND p_partkey NOT BETWEEN 100 AND 200 AND p_brand NOT IN ('Brand#1', 'Brand#2')""",
)
def filter_between_in(t):
    return t.part.filter(
        F.col("p_size").between(10, 20)
        & F.col("p_type").isin("ECONOMY", "SMALL", "PROMO")
        & ~F.col("p_partkey").between(100, 200)
        & ~F.col("p_brand").isin("Brand#1", "Brand#2")
    ).select("p_partkey", "p_size", "p_type")


@query(
    "filter_like_rlike",
    """SELECT p_partkey, p_name FROM part
       WHERE (p_name LIKE '%ring' OR regexp_matches(p_name, '^(red|blue) w')) AND p_name NOT LIKE 's_all%'
         AND NOT regexp_matches(p_brand, '#1[0-9]$')""",
)
def filter_like_rlike(t):
    name = F.col("p_name")
    return t.part.filter(
        (name.like("%ring") | name.rlike("^(red|blue) w"))
        & ~name.like("s_all%")
        & ~F.col("p_brand").rlike("#1[0-9]$")
    ).select("p_partkey", "p_name")


@query(
    "filter_null_distinct",
    """SELECT d.doc_id, l.quality, l.quality IS NULL AS unlabelled,
              l.quality IS DISTINCT FROM 1 AS not_good, l.quality IS NOT DISTINCT FROM l.toxic AS same
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.toxic IS NULL OR l.quality IS NOT NULL""",
)
def filter_null_distinct(t):
    quality, toxic = F.col("quality"), F.col("toxic")
    return (
        t.documents.select("doc_id")
        .join(t.labels, "doc_id", "left")
        .filter(toxic.isNull() | quality.isNotNull())
        .select(
            "doc_id",
            "quality",
            quality.isNull().alias("unlabelled"),
            (~quality.eqNullSafe(1)).alias("not_good"),
            quality.eqNullSafe(toxic).alias("same"),
        )
    )


@query(
    "compare_ops",
    """SELECT l_orderkey, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt,
              l_quantity <= 10 AS not_gt, l_quantity > 10 AS gt, l_quantity >= 10 AS not_lt,
              l_returnflag = 'A' AS flag_a
       FROM lineitem""",
)
def compare_ops(t):
    quantity = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey",
        (quantity == 10).alias("eq"),
        (quantity != 10).alias("ne"),
        (quantity < 10).alias("lt"),
        (~(quantity > 10)).alias("not_gt"),
        (quantity > 10).alias("gt"),
        (~(quantity < 10)).alias("not_lt"),
        F.col("l_returnflag").eqNullSafe("A").alias("flag_a"),
    )


@query(
    "case_when",
    """SELECT o_orderkey,
              CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
                   ELSE 'small' END AS size,
              CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code
       FROM orders""",
)
def case_when(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small").alias("size"),
        F.when(status == "F", 1).when(status == "O", 2).alias("code"),
    )


# --- subqueries -------------------------------------------------------------------


@query(
    "subquery_in",
    """SELECT c_custkey, 'in' AS side FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
       UNION ALL
       SELECT c_custkey, 'not in' FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def subquery_in(t):
    big = t.orders.filter(F.col("o_totalprice") > 400000).select("o_custkey")
    buyers = joins.distinct_values(big)
    inside = joins.is_in(t.customer, "c_custkey", buyers)
    outside = joins.not_in(t.customer, "c_custkey", buyers)
    return inside.select("c_custkey", F.lit("in").alias("side")).unionAll(
        outside.select("c_custkey", F.lit("not in").alias("side"))
    )


@query(
    "subquery_exists",
    """SELECT o_orderkey, o_orderpriority FROM orders o
       WHERE EXISTS (SELECT 1 FROM lineitem l
                     WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate
                       AND l.l_returnflag = 'R')""",
)
def subquery_exists(t):
    # Some line is later than the order exactly when the latest one is: one row per
    # order is enough to ask.
    latest = (
        t.lineitem.filter(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").alias("latest"))
    )
    matching = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("latest") > F.col("o_orderdate"))
    return t.orders.join(latest, matching, "left_semi").select("o_orderkey", "o_orderpriority")


@query(
    "subquery_scalar",
    """SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above,
              (SELECT max(s_acctbal) FROM supplier) AS richest
       FROM customer WHERE c_acctbal < (SELECT max(s_acctbal) FROM supplier)""",
)
def subquery_scalar(t):
    mean = t.customer.agg(F.avg("c_acctbal")).scalar()
    richest = t.supplier.agg(F.max("s_acctbal")).scalar()
    return t.customer.filter(F.col("c_acctbal") < richest).select(
        "c_custkey", (F.col("c_acctbal") > mean).alias("above"), richest.alias("richest")
    )


@query(
    "subquery_from",
    """SELECT q.flag, q.n, q.n * 100 AS scaled
       FROM (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag) q
       WHERE q.n > 0""",
)
def subquery_from(t):
    q = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).alias("q")
    return q.filter(F.col("q.n") > 0).select("q.flag", "q.n", (F.col("q.n") * 100).alias("scaled"))


_CTE = """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
               big AS (SELECT * FROM spend WHERE total > 1000000)
          SELECT c_mktsegment, count(*) AS n
          FROM {customer} JOIN big ON c_custkey = o_custkey GROUP BY c_mktsegment"""


@query("cte", _CTE.format(customer="customer"))
def cte(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    big = spend.filter(F.col("total") > 1000000)
    return (
        t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"))
    )


# --- set operations ---------------------------------------------------------------


def _nations(t):
    """Nation keys of customers, of suppliers, and of customers in debt: with repeats."""
    key = F.col("c_nationkey").alias("nationkey")
    return (
        t.customer.select(key),
        t.supplier.select(F.col("s_nationkey").alias("nationkey")),
        t.customer.filter(F.col("c_acctbal") < 0).select(key),
    )


_CUSTOMER = "SELECT c_nationkey AS nationkey FROM customer"
_SUPPLIER = "SELECT s_nationkey AS nationkey FROM supplier"
_DEBTOR = f"{_CUSTOMER} WHERE c_acctbal < 0"


@query("union_all", f"{_CUSTOMER} UNION ALL {_SUPPLIER}")
def union_all(t):
    customer, supplier, _ = _nations(t)
    return customer.unionAll(supplier)


@query("union_distinct", f"{_CUSTOMER} UNION {_SUPPLIER}")
def union_distinct(t):
    customer, supplier, _ = _nations(t)
    return sets.union_distinct(customer, supplier)


@query("intersect", f"{_CUSTOMER} INTERSECT {_SUPPLIER}")
def intersect(t):
    customer, supplier, _ = _nations(t)
    return sets.intersect(customer, supplier)


@query("intersect_all", f"{_CUSTOMER} INTERSECT ALL {_SUPPLIER}")
def intersect_all(t):
    customer, supplier, _ = _nations(t)
    return sets.intersect_all(customer, supplier)


@query(
    "except",
    """SELECT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'N'
       EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'""",
)
def except_(t):
    part = F.col("l_partkey").alias("partkey")
    kept = t.lineitem.filter(F.col("l_returnflag") == "N").select(part)
    returned = t.lineitem.filter((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R"))
    return sets.except_(kept, returned.select(part))


@query("except_all", f"{_CUSTOMER} EXCEPT ALL {_SUPPLIER}")
def except_all(t):
    customer, supplier, _ = _nations(t)
    return sets.except_all(customer, supplier)


@query(
    "setop_chain",
    f"""(({_SUPPLIER} UNION {_DEBTOR}) INTERSECT {_CUSTOMER} WHERE c_acctbal > 9000)
        EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""",
)
def setop_chain(t):
    _, supplier, debtor = _nations(t)
    rich = t.customer.filter(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("nationkey"))
    region = t.nation.filter(F.col("n_regionkey") == 1).select("n_nationkey")
    return sets.Chain(supplier).union(debtor).intersect(rich).except_(region).df


# --- sampling ---------------------------------------------------------------------


@query("sample_percent")
def sample_percent(t):
    return sampling.percent(t.lineitem, 10, seed=7)


@query(
    "sample_percent_by_key",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE CAST('0x' || substr(md5('7:' || l_orderkey), 1, 8) AS BIGINT) < 429496730""",
)
def sample_percent_by_key(t):
    return sampling.percent_by(t.lineitem.select("l_orderkey", "l_linenumber"), 10, "l_orderkey", seed=7)


@query(
    "sample_rows",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def sample_rows(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return sampling.rows(t.orders.select("o_orderkey", "o_totalprice"), 50, order)


@query("sample_bucket", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 2")
def sample_bucket(t):
    return sampling.bucket(t.orders, 3, 10, on="o_custkey").select("o_orderkey", "o_custkey")


@query(
    "sample_bytes",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang,
              sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS upto FROM documents)
       WHERE upto <= 1048576""",
)
def sample_bytes(t):
    size = F.octet_length("text")
    return sampling.first_bytes(t.documents, "1M", size, "doc_id").select("doc_id", "lang")


# --- generators -------------------------------------------------------------------


@query(
    "lateral_view",
    """SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, word
       FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
             FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents))""",
)
def lateral_view(t):
    words = F.split("text", " ", -1)
    return t.documents.select("doc_id", F.posexplode(words).alias("pos", "word"))


@query(
    "lateral_view_outer",
    """SELECT c.c_custkey, u.k AS nation_letter
       FROM customer c LEFT JOIN (
            SELECT c_custkey, unnest(CASE WHEN c_acctbal < 0 THEN []
                                     ELSE string_split(c_mktsegment, 'I') END) AS k
            FROM customer) u ON c.c_custkey = u.c_custkey""",
)
def lateral_view_outer(t):
    empty = F.array().cast("array<string>")
    pieces = F.when(F.col("c_acctbal") < 0, empty).otherwise(F.split("c_mktsegment", "I", -1))
    return t.customer.select("c_custkey", F.explode_outer(pieces).alias("nation_letter"))


@query(
    "script_transform",
    """SELECT doc_id, CAST(n_chars // 100 AS BIGINT) AS hundreds, upper(lang) AS lang
       FROM documents WHERE n_chars >= 100""",
)
def script_transform(t):
    def script(batches):
        for batch in batches:
            long = batch[batch.n_chars >= 100]
            yield long.assign(hundreds=long.n_chars // 100, lang=long.lang.str.upper())[
                ["doc_id", "hundreds", "lang"]
            ]

    return user_defined.transform(
        t.documents.select("doc_id", "n_chars", "lang"),
        script,
        "doc_id long, hundreds long, lang string",
    )


@query(
    "script_reduce",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS rows
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def script_reduce(t):
    return user_defined.sum_and_count(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
