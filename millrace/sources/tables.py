"""The input tables, each a parquet path read on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Declared rather than inferred: a read then starts no job of its own.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """``Tables(spark, path).orders`` is the lazily scanned ``orders`` table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def location(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def size(self) -> int:
        """Bytes of all files, as the store lists them: one request to it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf).getContentSummary(path).getLength()

    def register(self) -> None:
        """Make every table a temporary view, for plain SQL text over them."""
        for name in SCHEMAS:
            self.view(name)

    def view(self, name: str, as_name: str | None = None) -> str:
        """Register the table for SQL text and return the view's name."""
        as_name = as_name or name
        getattr(self, name).createOrReplaceTempView(as_name)
        return as_name


def _reader(name: str) -> cached_property:
    def read(self: Tables) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.location(name))

    return cached_property(read)


for _name in SCHEMAS:
    _prop = _reader(_name)
    _prop.__set_name__(Tables, _name)
    setattr(Tables, _name, _prop)
