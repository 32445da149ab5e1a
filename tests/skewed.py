"""Time window operators on a skewed table, split form against Spark's plain window.

``python -m tests.skewed [rows]``: one key holds a third of the rows, which are written below the
session's work folder first. Prints a line for each operator.
"""

import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import workdir
from millrace.operators import skew, windows
from millrace.session import local_session


def seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    spark = local_session("skewed", cores=8)
    made = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"),
        F.xxhash64("id").alias("at"),
        (F.col("id") % 97).cast("double").alias("v"),
    )
    table = workdir.materialise(made, "skewed")
    keys, order = ["k"], [F.col("at").asc()]
    over = Window.partitionBy("k").orderBy("at")
    forms = {
        "row_number": (
            lambda: table.withColumn("n", F.row_number().over(over)),
            lambda: windows.number_rows(table, keys, order, "n"),
        ),
        "running sum": (
            lambda: table.withColumn("s", F.sum("v").over(over.rowsBetween(Window.unboundedPreceding, 0))),
            lambda: windows.running(table, keys, order, {"s": F.col("v")}),
        ),
        "rows frame": (
            lambda: table.withColumn("s", F.sum("v").over(over.rowsBetween(-3, 1))),
            lambda: windows.rows_frame(table, keys, order, {"s": windows.RowsFrame("sum", F.col("v"), 3, 1)}),
        ),
    }
    print(f"{rows} rows, limit {skew.TASK_ROWS} a group")
    for name, (plain, split) in forms.items():
        start = time.perf_counter()
        result = split()
        built = time.perf_counter() - start
        print(f"{name}: plain {seconds(plain()):.1f} s, split {built + seconds(result):.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
