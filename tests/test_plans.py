"""What Spark makes of the registered queries."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace import workdir
from millrace.operators import skew, windows
from millrace.plans import QUERIES as OWN
from millrace.sources import sinks
from tests.plans import physical, scans

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {key: contract.queries()[key] for key in OWN}


@pytest.fixture(scope="module", autouse=True)
def whole_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(scope="module")
def without_broadcast(spark):
    """Plans as for tables past any broadcast threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    (scan,) = scans(QUERIES["parquet_pushdown"](spark, SF_DIR))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in scan
    assert "GreaterThanOrEqual(l_shipdate" in scan
    assert set(re.findall(r"[(,<](l_\w+):", scan)) <= {"l_orderkey", "l_quantity", "l_shipdate"}
    assert "l_comment" not in scan and "l_extendedprice" not in scan


def test_partition_filters_prune(spark):
    name = workdir.fresh_name("pruned")
    df = spark.range(20).withColumn("k", F.col("id") % 4)
    table = sinks.create_table(df, name, workdir.fresh_path(spark, name), partition_by=["k"])
    (scan,) = scans(table.filter("k = 3 AND id > 5"))
    assert re.search(r"PartitionFilters: \[[^\]]*k#\d+L? = 3", scan)
    assert "GreaterThan(id,5)" in scan


def test_flagship_reads_only_what_it_uses(without_broadcast):
    df = contract.queries()["top_unshipped_orders"](without_broadcast, SF_DIR)
    plan = physical(df)
    assert "TakeOrderedAndProject" in plan
    for scan in scans(df):
        assert "PushedFilters: []" not in scan
    # Aggregation reuses the partitioning of the join: one exchange per input and join.
    assert plan.count("Exchange hashpartitioning") == 4


JOINS_OF_SMALL_TABLES = {"join_cross"}  # a checked handful of rows, broadcast


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pairwise_joins_or_single_task_windows(without_broadcast, key):
    plan = physical(QUERIES[key](without_broadcast, SF_DIR))
    if key not in JOINS_OF_SMALL_TABLES:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            # A window without a partition key would run in one task.
            assert not re.search(r"\], \[\](, \[|$)", line), line


PYTHON = {"script_transform", "script_reduce", "udf_scalar", "udf_scalar_pandas", "udaf_grouped", "udtf_rows"}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - PYTHON))
def test_no_python_outside_the_python_operators(spark, key):
    plan = physical(QUERIES[key](spark, SF_DIR))
    for node in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups", "AggregateInPandas"):
        assert node not in plan


@pytest.mark.parametrize("key", sorted(PYTHON))
def test_python_operators_are_vectorised(spark, key):
    assert "BatchEvalPython" not in physical(QUERIES[key](spark, SF_DIR))


@pytest.mark.parametrize("key", ["window_ranking", "window_analytic", "window_rows_frame", "window_named", "window_nth_value", "window_ignore_nulls", "window_open_frames"])
def test_hot_windows_cut_once(spark, key, monkeypatch):
    """All functions of a window share one cut and one table of summaries, and the base is read for the cold and for the hot rows."""
    written = []
    monkeypatch.setattr(windows, "materialise", lambda df, label: (written.append((label, df)), workdir.materialise(df, label))[1])
    measure = skew.group_sizes
    monkeypatch.setattr(skew, "group_sizes", lambda df, keys, limit=5: measure(df, keys, limit))
    result = QUERIES[key](spark, SF_DIR)
    labels = [label for label, _ in written]
    ranked = labels.index("window-values") if "window-values" in labels else len(labels)
    assert labels[:ranked] == ["window-pieces", "piece-totals", "window-numbers"][:ranked] and ranked >= 2
    base = [scan for df in [result, *[df for _, df in written]] for scan in scans(df) if SF_DIR in scan]
    assert len(base) == 2
    plain = measure(result, ["event_id" if "event_id" in result.columns else "o_orderkey"], 10**9)
    assert plain.rows == spark.read.parquet(f"{SF_DIR}/{'events' if 'event_id' in result.columns else 'orders'}.parquet").count()
