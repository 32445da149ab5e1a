import pytest
from pyspark.sql import functions as F

from millrace.functions import casting


@pytest.mark.parametrize(
    "text,value",
    [
        ("12", 12), (" -7\t", -7), ("+3", 3), ("1.9", 1), ("5.", 5), ("", None), ("x", None),
        ("1-", None), (".5", None), ("2147483648", None), ("1e3", None), (None, None), ("- 1", None),
    ],
)
def test_whole_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(casting.whole_number(F.col("t"))).first()[0] == value
