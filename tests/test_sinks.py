import os
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import workdir
from millrace.sources import delimited, sinks, snapshot
from tests.plans import scans


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "x")], "id long, k string, m string"
    )


@pytest.fixture
def table(spark, sales):
    name = workdir.fresh_name("sales")
    sinks.create_table(sales, name, workdir.fresh_path(spark, name), partition_by=["k"])
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_shared_root_is_the_configured_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "/shared/folder/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    own = f"/shared/folder/millrace-{spark.sparkContext.applicationId}"
    assert workdir.shared_root(Session()) == own


def test_shared_root_is_required_off_local(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        workdir.shared_root(Session())


def test_insert_into_takes_partition_values_from_the_spec(spark, table, sales, rows):
    sinks.insert_into(sales.filter("id = 3").drop("k"), table, {"k": "new"})
    assert rows(spark.table(table), "id", "k") == [
        (1, "a"), (2, "a"), (3, "b"), (3, "new"), (4, None),
    ]


def test_insert_is_by_name_not_position(spark, table, rows):
    shuffled = spark.createDataFrame([("m1", "z", 9)], "m string, k string, id long")
    sinks.insert_into(shuffled, table)
    assert (9, "z", "m1") in rows(spark.table(table), "id", "k", "m")


def test_dynamic_overwrite_keeps_other_partitions(spark, table, rows):
    new = spark.createDataFrame([(7, "n", "a")], "id long, m string, k string")
    sinks.insert_overwrite(new, table, {"k": None})
    assert rows(spark.table(table), "id", "k") == [(3, "b"), (4, None), (7, "a")]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_static_mode_drops_partitions_the_spec_covers(spark, table, rows):
    new = spark.createDataFrame([(7, "n", "a")], "id long, m string, k string")
    sinks.insert_overwrite(new, table, {"k": None}, mode="static")
    assert rows(spark.table(table), "id", "k") == [(7, "a")]


def test_partition_values_are_quoted(spark, table, rows):
    new = spark.createDataFrame([(7, "n")], "id long, m string")
    for value in ("it's", 'say "x"', "back\\slash", "{rows}"):
        sinks.insert_into(new, table, {"k": value})
        assert spark.table(table).filter(F.col("k") == value).count() == 1


def test_static_partition_overwrite(spark, table, rows):
    new = spark.createDataFrame([(8, "n")], "id long, m string")
    sinks.insert_overwrite(new, table, {"k": "b"})
    assert rows(spark.table(table), "id", "k") == [(1, "a"), (2, "a"), (4, None), (8, "b")]


def test_static_overwrite_with_no_rows_empties_the_partition(spark, table, sales, rows):
    sinks.insert_overwrite(sales.filter("id > 99"), table, {"k": "a"})
    assert rows(spark.table(table), "id") == [(3,), (4,)]


def test_overwrite_of_a_whole_table(spark, table, rows):
    new = spark.createDataFrame([(8, "n", "q")], "id long, m string, k string")
    sinks.insert_overwrite(new, table)
    assert rows(spark.table(table), "id", "k") == [(8, "q")]


def test_overwrite_if_not_exists(spark, table, rows):
    new = spark.createDataFrame([(8, "n")], "id long, m string")
    sinks.insert_overwrite(new, table, {"k": "a"}, if_not_exists=True)
    assert len(rows(spark.table(table))) == 4
    sinks.insert_overwrite(new, table, {"k": "fresh"}, if_not_exists=True)
    assert (8, "fresh") in rows(spark.table(table), "id", "k")
    with pytest.raises(ValueError):
        sinks.insert_overwrite(new, table, {"k": None}, if_not_exists=True)


def test_bucketed_tables_join_without_a_shuffle(spark):
    names = []
    for seed in (1, 2):
        name = workdir.fresh_name("bucketed")
        df = spark.range(1000).withColumn("v", F.col("id") * seed)
        sinks.create_table(
            df, name, workdir.fresh_path(spark, name), bucket_by=["id"], buckets=4, sort_by=["id"]
        )
        names.append(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(names[0]).join(spark.table(names[1]), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_create_table_refuses_an_existing_one(spark, table, sales):
    with pytest.raises(AnalysisException):
        sinks.create_table(sales, table, workdir.fresh_path(spark, "again"))


def test_write_if_absent_and_override(spark, sales, rows):
    path = workdir.fresh_path(spark, "object")
    sinks.write_if_absent(sales, path)
    sinks.write_if_absent(sales.limit(0), path)
    assert spark.read.parquet(path).count() == 4
    sinks.write_if_absent(sales.filter("id = 1"), path, override=True)
    assert spark.read.parquet(path).count() == 1


def test_multi_insert_sinks(spark, sales, rows):
    branches = {
        "low": sinks.Branch(F.col("id") <= 2, {"id": F.col("id")}),
        "x": sinks.Branch(F.col("m") == "x", {"id": F.col("id") * 10, "k": F.upper("k")}),
        "none": sinks.Branch(F.lit(False), {"id": F.col("id")}),
    }
    root = workdir.fresh_path(spark, "multi")
    paths = sinks.multi_insert(sales, branches, root)
    assert rows(spark.read.parquet(paths["low"]), "id", "k") == [(1, None), (2, None)]
    assert rows(spark.read.parquet(paths["x"]), "id", "k") == [(10, "A"), (30, "B"), (40, None)]
    assert not os.path.exists(paths["none"])


def test_batches(spark, rows):
    path = workdir.fresh_path(spark, "batches")
    students = spark.range(1001).select("id", F.concat(F.lit("student_"), "id").alias("name"))
    sinks.write_batches(students, path, 10)
    back = spark.read.schema("id bigint, name string, batch int").csv(path)
    assert back.count() == 10010
    assert rows(back.filter("id = 1000").select("name").distinct()) == [("student_1000",)]
    with pytest.raises(AnalysisException):
        sinks.write_batches(students, path, 10)


def test_batches_are_not_sorted(spark, monkeypatch):
    """A task writes to all batches at once, be there one or several files of it, and the session stays as it was."""
    setting, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before, csv = spark.conf.get(setting), DataFrameWriter.csv

    def recorded(writer, path):
        seen.append(int(spark.conf.get(setting)))
        csv(writer, path)

    monkeypatch.setattr(DataFrameWriter, "csv", recorded)
    for batches, files in ((10, 200), (7, 3)):
        monkeypatch.setattr(sinks, "OPEN_FILES", files)
        path = workdir.fresh_path(spark, "batches")
        sinks.write_batches(spark.range(500, numPartitions=3), path, batches)
        back = spark.read.schema("id bigint, batch int").csv(path)
        assert back.distinct().count() == back.count() == 500 * batches
        assert seen.pop() == min(batches, files) and spark.conf.get(setting) == before


NASTY = ["", "plain", "a|b", "back\\slash", "\\", "\\|", "line\nbreak", "c,d:e", "\\N", "ü|\\\\|"]


@pytest.mark.parametrize("lines", ["\n", "\x1e", "\r\n"])
@pytest.mark.parametrize("marks", [{}, {"fields": "|", "items": ",", "keys": ":"}])
def test_delimited_round_trip(spark, rows, lines, marks):
    fmt = delimited.RowFormat(**marks, lines=lines)
    schema = T.StructType().add("id", "long").add("s", "string")
    schema = schema.add("a", T.ArrayType(T.StringType())).add("m", T.MapType(T.StringType(), T.IntegerType()))
    data = [(i, s, [s, None, "z"], {s: i, "k": None}) for i, s in enumerate(NASTY)]
    data += [(50, None, None, None), (51, "x", [], {}), (None, "y", ["only"], {"a": 1})]
    data += [(52, "\\l", ["\\e"], {"": 1}), (53, "\r\n\x1e\x01", [""], {"\n": None}), (54, "\\\\l\n\nl", ["", ""], {})]
    df = spark.createDataFrame(data, schema)
    path = workdir.fresh_path(spark, "delimited")
    delimited.write_delimited(df, path, fmt)
    back = delimited.read_delimited(spark, path, schema, fmt)
    have = {r["s"] if r["id"] is None else r["id"]: tuple(r) for r in back.collect()}
    want = {r[1] if r[0] is None else r[0]: r for r in data}
    assert have == want


def test_delimited_long_cells(spark):
    text = "a|b\\" * 200_000
    df = spark.createDataFrame([(text,)], "s string")
    path = workdir.fresh_path(spark, "long")
    fmt = delimited.RowFormat(fields="|")
    delimited.write_delimited(df, path, fmt)
    assert delimited.read_delimited(spark, path, df.schema, fmt).first()["s"] == text


def test_snapshot_manifest_and_contents(spark, sales, rows):
    name = workdir.fresh_name("snap")
    manifest = snapshot.make_snapshot(
        sales, name, partitions=[{"k": "a", "m": "x"}, {"k": None, "m": "y"}, {"k": "b", "m": None}]
    )
    assert rows(manifest, "k", "m", "rows") == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]
    assert rows(spark.table(name), "id") == [(1,), (2,), (3,)]
    again = snapshot.make_snapshot(
        sales.orderBy(F.desc("id")), workdir.fresh_name("snap"), partition_by=["k", "m"]
    )
    sums = {tuple(r)[:2]: r["checksum"] for r in again.collect()}
    assert all(sums[(r["k"], r["m"])] == r["checksum"] for r in manifest.collect())
    assert len(sums) == 4


def test_snapshot_refuses_existing_targets(spark, sales):
    name, path = workdir.fresh_name("snap"), workdir.fresh_path(spark, "snap")
    snapshot.make_snapshot(sales, name, path)
    with pytest.raises(AnalysisException):
        snapshot.make_snapshot(sales, name)
    with pytest.raises(AnalysisException):
        snapshot.make_snapshot(sales, workdir.fresh_name("snap"), path)


def test_checksums_of_other_rows_differ_and_sums_do_not_overflow(spark):
    df = spark.createDataFrame([("a|vb", "c"), ("a", "b|vc")], "a string, b string")
    assert df.select(snapshot.row_checksum(["a", "b"])).distinct().count() == 2
    manifest = snapshot.make_snapshot(df, workdir.fresh_name("snap"))
    assert dict(manifest.dtypes)["checksum"] == "decimal(38,0)"


def test_bucket_counts_stay_within_the_maximum():
    assert [sinks.bucket_count(n) for n in (1, 64_000_001, 10**13, 10**16)] == [8, 16, 65536, 65536]


def test_row_checksum_tells_null_from_empty(spark):
    df = spark.createDataFrame([("", None), (None, "")], "a string, b string")
    assert df.select(snapshot.row_checksum(["a", "b"])).distinct().count() == 2


def test_directory_formats(spark, sales, rows):
    for provider in ("parquet", "orc", "json", "csv"):
        path = workdir.fresh_path(spark, provider)
        sinks.write_directory(sales, path, provider)
        sinks.write_directory(sales.filter("id < 3"), path, provider)
        back = spark.read.schema(sales.schema).format(provider).load(path)
        assert rows(back, "id") == [(1,), (2,)]


def test_skewed_table_reads_back_and_prunes(spark, sales, rows):
    named = sales.withColumn("K_folder", sales["id"])  # the name the folder would have
    path = workdir.fresh_path(spark, "skewed")
    table = sinks.create_skewed(named, path, "k", ["a", None, "a", "absent"])
    assert table.all().schema == named.schema
    assert rows(table.all()) == rows(named)
    assert rows(table.among(["a"]), "id") == [(1,), (2,)]
    assert rows(table.among([None, "b"]), "id") == [(3,), (4,)]
    assert rows(table.among(["absent"]), "id") == rows(table.among([]), "id") == []
    assert rows(table.rest(), "id") == [(3,)]
    (scan,) = scans(table.among(["a"]))
    assert re.search(r"PartitionFilters: \[[^\]]*k_folder_#\d+ = 0|PartitionFilters: \[[^\]]*k_folder_#\d+ IN", scan)
    assert {f.split("k_folder_=")[1].split("/")[0] for f in table.all().inputFiles()} == {"0", "1", "-1"}
    empty = sinks.create_skewed(named.limit(0), workdir.fresh_path(spark, "skewed"), "k", ["a"])
    assert empty.all().count() == empty.among(["a"]).count() == 0
