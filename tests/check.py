"""Run every query against its oracle: ``python -m tests.check [sf] [key ...]``."""

import sys
import time

import __spark_entry__ as contract
from millrace.session import local_session
from tests.oracle import connect, differences


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(cores=8), connect(path)
    queries, oracles = contract.queries(), contract.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, path)
            if key in oracles:
                found = differences(df, oracles[key], con)
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {key} {time.time() - start:.2f}s", flush=True)
        for line in found:
            print("     ", line[:800], flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
