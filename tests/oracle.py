"""Compare a registered query with its oracle SQL: names, types and all values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

# Spark type -> DuckDB type a column must have in the oracle's result.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def _bag(rows, order) -> Counter:
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs between the two results; empty when they agree."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    have_types = dict(df.dtypes)
    found = []
    if sorted(want_types) != sorted(have_types):
        return [f"columns {sorted(have_types)} != {sorted(want_types)}"]
    for name, kind in have_types.items():
        if TYPES.get(kind) != want_types[name]:
            found.append(f"type of {name}: {kind} != {want_types[name]}")
    names = sorted(have_types)
    have = _bag(df.collect(), [df.columns.index(n) for n in names])
    want = _bag(relation.fetchall(), [relation.columns.index(n) for n in names])
    if have != want:
        found.append(f"{have.total()} rows, {want.total()} expected")
        found.append(f"only Spark: {list((have - want).items())[:3]}")
        found.append(f"only oracle: {list((want - have).items())[:3]}")
    return found
