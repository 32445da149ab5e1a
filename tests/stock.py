"""Time registered queries against the same statement as plain SQL text.

``python -m tests.stock [sf]`` prints a Markdown table: the text is what a user of
stock Spark SQL sends, on the same session, tables and cores.
"""

import statistics
import sys
import time

import __spark_entry__ as contract
from millrace.session import local_session
from millrace.sources.tables import Tables
from tests.test_sql_text import STATEMENTS


def median(make, runs=3):
    def once():
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return statistics.median(once() for _ in range(runs))


def main():
    path = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.1'}"
    spark, queries = local_session(cores=8), contract.queries()
    Tables(spark, path).register()
    print("| query | this repository, s | plain SQL text, s |\n| --- | --- | --- |")
    for key, text in sorted(STATEMENTS.items()):
        ours = median(lambda: queries[key](spark, path))
        stock = median(lambda: spark.sql(text))
        print(f"| `{key}` | {ours:.2f} | {stock:.2f} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
