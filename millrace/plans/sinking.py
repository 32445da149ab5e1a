"""Sinks: each query writes to the shared folder and returns what it reads back."""

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources import delimited, sinks, snapshot
from millrace.workdir import fresh_name, fresh_path


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(
    "insert_into",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
       UNION ALL
       SELECT o_orderkey, o_custkey, o_totalprice, 'X' FROM orders WHERE o_orderstatus = 'P'""",
)
def insert_into(t):
    name = fresh_name("inserted")
    orders = _orders(t)
    sinks.create_table(orders, name, fresh_path(t.spark, name), partition_by=["o_orderstatus"])
    pending = orders.filter(F.col("o_orderstatus") == "P").drop("o_orderstatus")
    sinks.insert_into(pending, name, {"o_orderstatus": "X"})
    return t.spark.table(name)


@query(
    "insert_overwrite_partition",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL
       SELECT o_orderkey, o_custkey, -o_totalprice, 'P' FROM orders
       WHERE o_orderstatus = 'P' AND o_totalprice > 200000""",
)
def insert_overwrite_partition(t):
    name = fresh_name("overwritten")
    orders = _orders(t)
    sinks.create_table(orders, name, fresh_path(t.spark, name), partition_by=["o_orderstatus"])
    large = orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000))
    replaced = large.withColumn("o_totalprice", -F.col("o_totalprice"))
    sinks.insert_overwrite(replaced, name, {"o_orderstatus": None})
    # Already there, so this must leave the partition alone.
    sinks.insert_overwrite(orders, name, {"o_orderstatus": "F"}, if_not_exists=True)
    return t.spark.table(name)


@query(
    "insert_overwrite_dir",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0""",
)
def insert_overwrite_dir(t):
    path = fresh_path(t.spark, "directory")
    rich = t.customer.filter(F.col("c_acctbal") > 0).select("c_custkey", "c_name", "c_mktsegment")
    sinks.write_directory(t.customer, path, "orc")
    sinks.write_directory(rich, path, "json", {"compression": "gzip"})
    return t.spark.read.schema(rich.schema).json(path)


@query(
    "delimited_text_sink",
    """SELECT doc_id, text, array_to_string(tags, '/') AS tags, source AS by_key,
              CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang
       FROM (SELECT *, [lang, source, 'x|y'] AS tags FROM documents)""",
)
def delimited_text_sink(t):
    path = fresh_path(t.spark, "delimited")
    fmt = delimited.RowFormat(fields="|", items=",", keys=":")
    nested = t.documents.select(
        "doc_id",
        "text",
        F.array("lang", "source", F.lit("x|y")).alias("tags"),
        F.create_map(F.lit("src:"), F.col("source"), F.lit("lang"), F.col("lang")).alias("facts"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
    )
    delimited.write_delimited(nested, path, fmt)
    back = delimited.read_delimited(t.spark, path, nested.schema, fmt)
    return back.select(
        "doc_id",
        "text",
        F.array_join("tags", "/").alias("tags"),
        F.try_element_at("facts", F.lit("src:")).alias("by_key"),
        "lang",
    )


@query(
    "multi_insert",
    """SELECT 'late' AS sink, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01'
       UNION ALL
       SELECT 'bulk', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40""",
)
def multi_insert(t):
    columns = {c: F.col(c) for c in ("l_orderkey", "l_linenumber")}
    branches = {
        "late": sinks.Branch(
            F.col("l_shipdate") > F.lit("1999-01-01").cast("timestamp_ntz"), columns
        ),
        "bulk": sinks.Branch(F.col("l_quantity") > 40, columns),
    }
    root = fresh_path(t.spark, "multi")
    sinks.multi_insert(t.lineitem, branches, root)
    return t.spark.read.parquet(root).select("sink", "l_orderkey", "l_linenumber")


@query(
    "create_bucketed",
    """SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem
       ON o_orderkey = l_orderkey""",
)
def create_bucketed(t):
    left, right = fresh_name("orders_by_key"), fresh_name("lines_by_key")
    buckets = sinks.bucket_count(t.lineitem.count())
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    a = sinks.create_table(
        orders,
        left,
        fresh_path(t.spark, left),
        partition_by=["o_orderstatus"],
        bucket_by=["o_orderkey"],
        buckets=buckets,
        sort_by=["o_orderkey"],
    )
    b = sinks.create_table(
        lines,
        right,
        fresh_path(t.spark, right),
        bucket_by=["l_orderkey"],
        buckets=buckets,
        sort_by=["l_orderkey"],
    )
    return a.join(b, a["o_orderkey"] == b["l_orderkey"]).select(
        "o_orderkey", "o_totalprice", "l_linenumber", "l_quantity"
    )


@query(
    "create_skewed",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
       UNION ALL
       SELECT o_orderkey, o_custkey, -o_totalprice, o_orderpriority FROM orders
       WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL""",
)
def create_skewed(t):
    """Two values of a skewed table, one of them listed, and all that are not listed."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    table = sinks.create_skewed(orders, fresh_path(t.spark, "skewed"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return table.among(["1-URGENT", "5-LOW"]).unionAll(table.rest().withColumn("o_totalprice", -F.col("o_totalprice")))


@query(
    "make_snapshot",
    """SELECT l_returnflag, l_linestatus, count(*) AS rows,
              CAST(sum(CAST('0x' || substr(md5('v' || length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey
                     || 'v' || length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber), 1, 8) AS BIGINT))
                   AS VARCHAR) AS checksum
       FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR l_returnflag = 'R'
       GROUP BY l_returnflag, l_linestatus""",
)
def make_snapshot(t):
    manifest = snapshot.make_snapshot(
        t.lineitem,
        fresh_name("snapshot"),
        partitions=[
            {"l_returnflag": "A", "l_linestatus": "F"},
            {"l_returnflag": "R", "l_linestatus": None},
        ],
        checksum=["l_orderkey", "l_linenumber"],
    )
    return manifest.withColumn("checksum", F.col("checksum").cast("string"))



@query(
    "demo_csv_export",
    """SELECT CAST(b AS INTEGER) AS batch, c_custkey AS id, 'student_' || c_custkey AS name
       FROM customer, range(1, 11) r(b)""",
)
def demo_csv_export(t):
    path = fresh_path(t.spark, "csv")
    students = t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("student_"), "c_custkey").alias("name")
    )
    sinks.write_batches(students, path, 10)
    return t.spark.read.schema("id bigint, name string, batch int").csv(path)


@query(
    "sink_if_absent",
    """SELECT s_suppkey, 'kept' AS state FROM supplier
       UNION ALL SELECT p_partkey, 'replaced' FROM part""",
)
def sink_if_absent(t):
    kept, replaced = fresh_path(t.spark, "absent"), fresh_path(t.spark, "override")
    suppliers = t.supplier.select(F.col("s_suppkey").alias("key"))
    parts = t.part.select(F.col("p_partkey").alias("key"))
    for path in (kept, replaced):
        sinks.write_if_absent(suppliers, path)
    sinks.write_if_absent(parts, kept)
    sinks.write_if_absent(parts, replaced, override=True)
    read = t.spark.read.schema(parts.schema)
    return (
        read.parquet(kept)
        .select(F.col("key").alias("s_suppkey"), F.lit("kept").alias("state"))
        .unionAll(read.parquet(replaced).select("key", F.lit("replaced")))
    )


@query(
    "partition_at_path",
    """SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'""",
)
def partition_at_path(t):
    path = fresh_path(t.spark, "partition")
    events = t.events.select("event_id", "user_id", "value", "event_type")
    sinks.write_partition_at(events, {"event_type": "purchase"}, path)
    return t.spark.read.schema(events.schema).parquet(path).drop("event_type")
