"""Window operators: the split form of hot groups equals the plain window."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import skew, windows

LIMIT = 40


@pytest.fixture(scope="module")
def table(spark):
    """Group 'hot' holds well over a third of the rows; a null group is hot too."""
    rng = random.Random(11)
    records = []
    for i in range(900):
        key = rng.choices(["hot", None, "a", "b", "c", "one"], [40, 20, 6, 3, 3, 0])[0]
        records.append((i, key, rng.choice([None, *range(30)]), rng.choice([None, *range(-50, 50)])))
    records.append((900, "one", 5, 5))
    frame = pd.DataFrame(records, columns=["id", "key", "pos", "v"]).astype(
        {"pos": "Int64", "v": "Int64"}
    )
    df = spark.createDataFrame(records, "id long, key string, pos long, v long").repartition(5).cache()
    con = duckdb.connect()
    con.register("t", frame)
    return df, con


def check(result, con, sql, columns):
    have = sorted(tuple(r) for r in result.select("id", *columns).collect())
    want = sorted(con.sql(sql).fetchall())
    assert have == want


def sizes(df, hot):
    found = skew.group_sizes(df, ["key"], LIMIT if hot else skew.TASK_ROWS)
    assert found.any_hot == hot
    return found


def order():
    return [F.col("pos").asc_nulls_first(), F.col("id").asc()]


SQL_ORDER = "ORDER BY pos NULLS FIRST, id"


@pytest.mark.parametrize("hot", [False, True])
def test_number_rows(table, hot):
    df, con = table
    result = windows.number_rows(df, ["key"], order(), "n", sizes(df, hot))
    check(result, con, f"SELECT id, row_number() OVER (PARTITION BY key {SQL_ORDER}) FROM t", ["n"])


@pytest.mark.parametrize("hot", [False, True])
def test_descending_order(table, hot):
    df, con = table
    backward = [F.col("pos").desc_nulls_last(), F.col("id").desc()]
    result = windows.number_rows(df, ["key"], backward, "n", sizes(df, hot))
    sql = "SELECT id, row_number() OVER (PARTITION BY key ORDER BY pos DESC NULLS LAST, id DESC) FROM t"
    check(result, con, sql, ["n"])


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("tiles", [1, 4, 700])
def test_tile_rows(table, hot, tiles):
    df, con = table
    result = windows.tile_rows(df, ["key"], order(), tiles, sizes=sizes(df, hot))
    sql = f"SELECT id, ntile({tiles}) OVER (PARTITION BY key {SQL_ORDER}) FROM t"
    check(result, con, sql, ["ntile"])


@pytest.mark.parametrize("hot", [False, True])
def test_rank_rows(table, hot):
    df, con = table
    result = windows.rank_rows(df, ["key"], ["pos"], sizes=sizes(df, hot))
    over = "OVER (PARTITION BY key ORDER BY pos NULLS FIRST)"
    check(result, con, f"SELECT id, rank() {over}, dense_rank() {over} FROM t", ["rank", "dense_rank"])


@pytest.mark.parametrize("hot", [False, True])
def test_rank_rows_descending(table, hot):
    df, con = table
    result = windows.rank_rows(df, ["key"], ["pos", "v"], sizes=sizes(df, hot), descending=["pos"])
    over = "OVER (PARTITION BY key ORDER BY pos DESC NULLS LAST, v NULLS FIRST)"
    check(result, con, f"SELECT id, rank() {over}, dense_rank() {over} FROM t", ["rank", "dense_rank"])


@pytest.mark.parametrize("hot", [False, True])
def test_share_rows(table, hot):
    df, con = table
    result = windows.share_rows(df, ["key"], ["pos"], sizes=sizes(df, hot))
    over = "OVER (PARTITION BY key ORDER BY pos NULLS FIRST)"
    sql = f"SELECT id, percent_rank() {over}, cume_dist() {over} FROM t"
    check(result, con, sql, ["percent_rank", "cume_dist"])


@pytest.mark.parametrize("hot", [False, True])
def test_running(table, hot):
    df, con = table
    result = windows.running(
        df, ["key"], order(), {"total": F.col("v"), "seen": F.lit(1).cast("long")}, sizes(df, hot)
    )
    over = f"OVER (PARTITION BY key {SQL_ORDER} ROWS UNBOUNDED PRECEDING)"
    have = sorted((tuple(r) for r in result.select("id", "total", "seen").collect()))
    want = sorted(con.sql(f"SELECT id, sum(v) {over}::BIGINT, count(*) {over} FROM t").fetchall())
    assert have == want


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("reach", [1, 3, 60])
def test_rows_frame(table, hot, reach):
    df, con = table

    frames = {
        "before": windows.Neighbour(F.col("id"), reach),
        "after": windows.Neighbour(F.col("id"), -reach),
        "near": windows.RowsFrame("sum", F.col("id"), reach, reach),
    }
    result = windows.rows_frame(df, ["key"], order(), frames, sizes(df, hot))
    w = f"(PARTITION BY key {SQL_ORDER} ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    plain = f"(PARTITION BY key {SQL_ORDER})"
    sql = f"""SELECT id, lag(id, {reach}) OVER {plain}, lead(id, {reach}) OVER {plain},
              (sum(id) OVER {w})::BIGINT FROM t"""
    have = {r["id"]: tuple(r) for r in result.select("id", "before", "after", "near").collect()}
    want = {r[0]: r for r in con.sql(sql).fetchall()}
    assert have == want and result.count() == 901


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("before,after", [(3, 0), (0, 2), (7, 4), (100, 100), (0, 0)])
def test_range_frame(table, hot, before, after):
    df, con = table
    frames = {
        "near": windows.RangeFrame("sum", F.col("id"), before, after),
        "n": windows.RangeFrame("count", F.col("v"), before, after),
        "low": windows.RangeFrame("min", F.col("v"), before, 0),
        "high": windows.RangeFrame("max", F.col("v"), 0, after),
    }
    shifted = df.withColumn("pos", F.col("pos") - 15)  # values on both sides of zero
    result = windows.range_frame(shifted, ["key"], "pos", frames, sizes(df, hot))

    def over(b, a):
        return f"""OVER (PARTITION BY key ORDER BY pos NULLS FIRST
                   RANGE BETWEEN {b} PRECEDING AND {a} FOLLOWING)"""

    sql = f"""SELECT id, (sum(id) {over(before, after)})::BIGINT, count(v) {over(before, after)},
              min(v) {over(before, 0)}, max(v) {over(0, after)} FROM t"""
    columns = ["id", "near", "n", "low", "high"]
    have = {r["id"]: tuple(r) for r in result.select(*columns).collect()}
    assert have == {r[0]: r for r in con.sql(sql).fetchall()}
    assert result.count() == 901


@pytest.mark.parametrize("hot", [False, True])
def test_group_totals_and_ends(table, hot):
    df, con = table
    found = sizes(df, hot)
    with_count = windows.group_totals(df, ["key"], {"n": F.count("*")}, found)
    result = windows.ends(with_count, ["key"], ["pos", "id"], "v", "first", "last", found)
    whole = f"""OVER (PARTITION BY key {SQL_ORDER}
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    sql = f"SELECT id, count(*) {whole}, first_value(v) {whole}, last_value(v) {whole} FROM t"
    have = {r["id"]: tuple(r) for r in result.select("id", "n", "first", "last").collect()}
    assert have == {r[0]: r for r in con.sql(sql).fetchall()}


def test_hot_pieces_stay_small(table):
    """No task of the split form holds more than a fraction of the hot group."""
    df, _ = table
    found = sizes(df, True)
    _, hot = skew.split_hot(df, ["key"], found)
    placed = windows._cut(hot, ["key"], order(), found)
    largest = placed.groupBy("key", windows._PIECE).count().agg(F.max("count")).first()[0]
    assert largest <= found.limit


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, key string, pos long, v long")
    assert windows.number_rows(empty, ["key"], order()).count() == 0
    assert windows.running(empty, ["key"], order(), {"s": F.col("v")}).count() == 0


def test_types_do_not_depend_on_the_size(table):
    df, _ = table
    df = df.withColumn("price", F.col("v").cast("decimal(12,2)"))
    frames = {"p": windows.RangeFrame("sum", F.col("price"), 3, 1), "n": windows.RangeFrame("count", F.col("v"), 1, 1)}
    rows = {"p": windows.RowsFrame("sum", F.col("price"), 2, 1), "a": windows.RowsFrame("avg", F.col("price"), 5, 0)}
    results = []
    for hot in (False, True):
        found = sizes(df, hot)
        results.append([
            windows.running(df, ["key"], order(), {"s": F.col("price"), "w": F.col("v")}, found),
            windows.range_frame(df, ["key"], "pos", frames, found),
            windows.rows_frame(df, ["key"], order(), rows, found),
            windows.rank_rows(df, ["key"], ["pos"], sizes=found),
            windows.tile_rows(df, ["key"], order(), 4, sizes=found),
        ])
    for plain, split in zip(*results, strict=True):
        assert sorted(plain.dtypes) == sorted(split.dtypes)
        columns = sorted(plain.columns)
        assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, split.select(columns).collect()))


def test_negative_reaches_are_refused():
    for kind in (windows.RowsFrame, windows.RangeFrame):
        with pytest.raises(ValueError):
            kind("sum", F.col("v"), -1, 2)


FUNCTIONS = {
    "lag(v, 2 IGNORE NULLS)": lambda: windows.Neighbour(F.col("v"), 2, ignore_nulls=True),
    "coalesce(lead(v, 1 IGNORE NULLS) OVER run, 7)": lambda: windows.Neighbour(F.col("v"), -1, 7, ignore_nulls=True),
    "lead(v, 90 IGNORE NULLS)": lambda: windows.Neighbour(F.col("v"), -90, ignore_nulls=True),
    "first_value(v)": lambda: windows.First(F.col("v")),
    "first_value(v IGNORE NULLS)": lambda: windows.First(F.col("v"), ignore_nulls=True),
    "last_value(v)": lambda: windows.Last(F.col("v")),
    "last_value(v IGNORE NULLS)": lambda: windows.Last(F.col("v"), ignore_nulls=True),
    "last_value(v IGNORE NULLS) OVER whole": lambda: windows.Last(F.col("v"), ignore_nulls=True, whole=True),
    "first_value(v IGNORE NULLS) OVER whole": lambda: windows.First(F.col("v"), ignore_nulls=True, whole=True),
    "nth_value(v, 3)": lambda: windows.Nth(F.col("v"), 3),
    "nth_value(v, 100)": lambda: windows.Nth(F.col("v"), 100),
    "nth_value(v, 5 IGNORE NULLS)": lambda: windows.Nth(F.col("v"), 5, ignore_nulls=True),
    "nth_value(v, 70 IGNORE NULLS) OVER whole": lambda: windows.Nth(F.col("v"), 70, ignore_nulls=True, whole=True),
    "nth_value(v, 9999) OVER whole": lambda: windows.Nth(F.col("v"), 9999, whole=True),
    "min(v)": lambda: windows.RowsFrame("min", F.col("v"), None, 0),
    "max(v) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 50 FOLLOWING)": lambda: windows.RowsFrame("max", F.col("v"), None, 50),
    "sum(v) OVER (run ROWS BETWEEN 3 PRECEDING AND UNBOUNDED FOLLOWING)": lambda: windows.RowsFrame("sum", F.col("v"), 3, None),
    "count(v) OVER (run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)": lambda: windows.RowsFrame("count", F.col("v"), 0, None),
    "min(v) OVER (run ROWS BETWEEN 60 PRECEDING AND UNBOUNDED FOLLOWING)": lambda: windows.RowsFrame("min", F.col("v"), 60, None),
    "min(v) OVER whole": lambda: windows.RowsFrame("min", F.col("v"), None, None),
    "count(*) OVER whole": lambda: windows.RowsFrame("count", F.lit(1), None, None),
    "round(avg(v) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING), 9)": lambda: windows.RowsFrame("avg", F.col("v"), None, 1),
    "row_number()": lambda: windows.RowNumber(),
    "ntile(7)": lambda: windows.Tile(7),
    "rank() OVER (PARTITION BY key ORDER BY pos NULLS FIRST)": lambda: windows.Rank("rank", ["pos"]),
    "cume_dist() OVER (PARTITION BY key ORDER BY v DESC NULLS LAST)": lambda: windows.Rank("cume_dist", ["v"], ["v"]),
    "dense_rank() OVER (PARTITION BY key ORDER BY v DESC NULLS LAST)": lambda: windows.Rank("dense_rank", ["v"], ["v"]),
}


@pytest.mark.parametrize("hot", [False, True])
def test_all_functions_of_one_window(table, hot, monkeypatch):
    """Every function equals SQL, and together they make one cut and one table of summaries."""
    df, con = table
    labels = []
    write = windows.materialise
    monkeypatch.setattr(windows, "materialise", lambda t, label: (labels.append(label), write(t, label))[1])
    functions = {f"f{k}": make() for k, make in enumerate(FUNCTIONS.values())}
    result = windows.windowed(df, ["key"], order(), functions, sizes(df, hot))
    columns = ", ".join(f"{sql if ' OVER ' in sql else sql + ' OVER run'} AS f{k}" for k, sql in enumerate(FUNCTIONS))
    text = f"""SELECT id, {columns} FROM t WINDOW run AS (PARTITION BY key {SQL_ORDER}),
              whole AS (PARTITION BY key {SQL_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    rounded = [F.round(c, 9).alias(c) if sql.startswith("round") else c for sql, c in zip(FUNCTIONS, functions, strict=True)]
    have = {r["id"]: tuple(r) for r in result.select("id", *rounded).collect()}
    want = {r[0]: tuple(r) for r in con.sql(text).fetchall()}
    assert len(have) == len(want) == 901 and result.count() == 901
    for k, text in enumerate(FUNCTIONS, 1):
        wrong = [(i, have[i][k], want[i][k]) for i in want if have[i][k] != want[i][k]]
        assert not wrong, (text, wrong[:5])
    if hot:
        # The ranks' distinct values are windowed by the same operator, cut where they are many.
        assert labels[:2] == ["window-pieces", "piece-totals"]
        assert labels.count("window-pieces") == labels.count("piece-totals") <= 1 + labels.count("window-values")
    else:
        assert not labels


def test_types_of_every_function(table):
    df, _ = table
    functions = {f"f{k}": make() for k, make in enumerate(FUNCTIONS.values())}
    one, other = (windows.windowed(df, ["key"], order(), functions, sizes(df, hot)) for hot in (False, True))
    assert one.dtypes == other.dtypes


def test_only_hot_rows_leave_the_plain_path(table):
    df, _ = table
    found = windows.windowed(df, ["key"], order(), {"n": windows.RowNumber(), "t": windows.Tile(3)}, sizes(df, True))
    placed = windows._cut(skew.split_hot(df, ["key"], sizes(df, True))[1], ["key"], order(), sizes(df, True))
    hot = {r["key"] for r in placed.select("key").distinct().collect()}
    assert hot == {"hot", None} | {k for k in ("a", "b", "c") if df.filter(F.col("key") == k).count() > LIMIT}
    assert found.count() == 901


def test_frames_and_numbers_are_checked():
    for make in (lambda: windows.RowsFrame("sum", F.col("v"), None, -1), lambda: windows.Nth(F.col("v"), 0)):
        with pytest.raises(ValueError):
            make()
