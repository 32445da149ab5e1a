import pytest
from pyspark.sql import types as T

from millrace.sources.tables import SCHEMAS, Tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_schema_is_the_files(spark, name):
    declared = getattr(Tables(spark, SF_DIR), name).schema
    written = spark.read.parquet(f"{SF_DIR}/{name}.parquet").schema
    assert [(f.name, f.dataType.simpleString()) for f in declared] == [
        (f.name, f.dataType.simpleString()) for f in written
    ]


def test_reading_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("reading", "reading")
    try:
        assert isinstance(Tables(spark, SF_DIR).lineitem.schema, T.StructType)
        assert list(tracker.getJobIdsForGroup("reading")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
