"""Window functions."""

from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.plans.registry import query


def _by_time():
    return [F.col("ts").asc(), F.col("event_id").asc()]


@query(
    "window_ranking",
    """SELECT event_id, user_id,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number,
              rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rank,
              dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dense_rank,
              CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS quarter
       FROM events""",
)
def window_ranking(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    ranks = {kind: windows.Rank(kind, ["event_type"]) for kind in ("rank", "dense_rank")}
    numbers = {"row_number": windows.RowNumber(), "quarter": windows.Tile(4)}
    return windows.windowed(events, ["user_id"], _by_time(), numbers | ranks).drop("ts", "event_type")


@query(
    "window_shares",
    """SELECT o_orderkey, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""",
)
def window_shares(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return windows.share_rows(
        orders, ["o_custkey"], ["o_totalprice"], descending=["o_totalprice"]
    ).select("o_orderkey", "percent_rank", "cume_dist")


@query(
    "window_analytic",
    """SELECT event_id, lag(event_type) OVER w AS previous, lead(event_id, 2) OVER w AS after_next,
              round(value - lag(value, 1, 0.0) OVER w, 2) AS change,
              first_value(event_type) OVER w AS first_type,
              last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def window_analytic(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    kind = F.col("event_type")
    functions = {
        "previous": windows.Neighbour(kind),
        "after_next": windows.Neighbour(F.col("event_id"), -2),
        "value_before": windows.Neighbour(F.col("value"), 1, 0.0),
        "first_type": windows.First(kind),
        "last_type": windows.Last(kind, whole=True),
    }
    found = windows.windowed(events, ["user_id"], _by_time(), functions)
    change = F.round(F.col("value") - F.col("value_before"), 2).alias("change")
    return found.select("event_id", "previous", "after_next", change, "first_type", "last_type")


@query(
    "window_nth_value",
    """WITH purchases AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events)
       SELECT event_id,
              nth_value(event_type, 3) OVER w AS third_type,
              nth_value(event_id, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fifth_event,
              nth_value(paid, 2 IGNORE NULLS) OVER w AS second_paid
       FROM purchases WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def window_nth_value(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    functions = {
        "third_type": windows.Nth(F.col("event_type"), 3),
        "fifth_event": windows.Nth(F.col("event_id"), 5, whole=True),
        "second_paid": windows.Nth(paid, 2, ignore_nulls=True),
    }
    found = windows.windowed(events, ["user_id"], _by_time(), functions)
    return found.select("event_id", *functions)


@query(
    "window_ignore_nulls",
    """WITH purchases AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events)
       SELECT event_id,
              lag(paid, 1 IGNORE NULLS) OVER w AS paid_before,
              coalesce(lead(paid, 2 IGNORE NULLS) OVER w, -1.0) AS paid_after_next,
              first_value(paid IGNORE NULLS) OVER w AS first_paid,
              last_value(paid IGNORE NULLS) OVER w AS latest_paid,
              last_value(paid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_paid
       FROM purchases WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def window_ignore_nulls(t):
    events = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    functions = {
        "paid_before": windows.Neighbour(paid, 1, ignore_nulls=True),
        "paid_after_next": windows.Neighbour(paid, -2, -1.0, ignore_nulls=True),
        "first_paid": windows.First(paid, ignore_nulls=True),
        "latest_paid": windows.Last(paid, ignore_nulls=True),
        "last_paid": windows.Last(paid, ignore_nulls=True, whole=True),
    }
    found = windows.windowed(events, ["user_id"], _by_time(), functions)
    return found.select("event_id", *functions)


@query(
    "window_open_frames",
    """SELECT event_id,
              min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lowest,
              max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN 2 PRECEDING AND UNBOUNDED FOLLOWING) AS highest_left,
              avg(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS average,
              count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS to_come,
              max(value) OVER (PARTITION BY user_id) AS highest
       FROM events""",
)
def window_open_frames(t):
    events = t.events.select("event_id", "user_id", "ts", "value")
    value = F.col("value")
    frames = {
        "lowest": windows.RowsFrame("min", value, None, 0),
        "highest_left": windows.RowsFrame("max", value, 2, None),
        "average": windows.RowsFrame("avg", F.col("event_id"), None, 1),
        "to_come": windows.RowsFrame("count", F.lit(1), 0, None),
        "highest": windows.RowsFrame("max", value, None, None),
    }
    found = windows.windowed(events, ["user_id"], _by_time(), frames)
    return found.select("event_id", *frames)


@query(
    "window_rows_frame",
    """SELECT event_id,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS nearby,
              count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) AS seen,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                ROWS UNBOUNDED PRECEDING), 2) AS running
       FROM events""",
)
def window_rows_frame(t):
    value = F.col("value")
    frames = {
        "nearby": windows.RowsFrame("sum", value, 2, 1),
        "seen": windows.RowsFrame("count", F.lit(1), 3, 0),
        "running": windows.RowsFrame("sum", value, None, 0),
    }
    events = t.events.select("event_id", "user_id", "ts", "value")
    found = windows.windowed(events, ["user_id"], _by_time(), frames)
    return found.select("event_id", F.round("nearby", 2).alias("nearby"), "seen", F.round("running", 2).alias("running"))


@query(
    "window_range_frame",
    """SELECT event_id,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000
                RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 2) AS last_day,
              count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000
                RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) AS within_hour
       FROM events""",
)
def window_range_frame(t):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp_ltz")).alias("second")
    events = t.events.select("event_id", "user_id", "value", seconds)
    frames = {
        "last_day": windows.RangeFrame("sum", F.col("value"), 86400, 0),
        "within_hour": windows.RangeFrame("count", F.lit(1), 3600, 3600),
    }
    return windows.range_frame(events, ["user_id"], "second", frames).select(
        "event_id", F.round("last_day", 2).alias("last_day"), "within_hour"
    )


@query(
    "window_named",
    """SELECT o_orderkey, row_number() OVER w AS nth, count(*) OVER (PARTITION BY o_custkey) AS orders,
              o_totalprice - lag(o_totalprice, 1, o_totalprice) OVER w AS change
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_named(t):
    # One named window, used by several functions: here a value passed around.
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    price = F.col("o_totalprice")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    functions = {
        "last_price": windows.Neighbour(price),
        "nth": windows.RowNumber(),
        "orders": windows.RowsFrame("count", F.lit(1), None, None),
    }
    found = windows.windowed(orders, ["o_custkey"], order, functions)
    change = (price - F.coalesce("last_price", price)).alias("change")
    return found.select("o_orderkey", "nth", "orders", change)


@query(
    "window_distribute_sort",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
              dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS place,
              count(*) OVER (PARTITION BY l_suppkey) AS lines
       FROM lineitem""",
)
def window_distribute_sort(t):
    # DISTRIBUTE BY … SORT BY inside OVER mean PARTITION BY … ORDER BY; CLUSTER BY
    # gives a partition without an order.
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    functions = {
        "place": windows.Rank("dense_rank", ["l_quantity"]),
        "lines": windows.RowsFrame("count", F.lit(1), None, None),
    }
    return windows.windowed(t.lineitem.select(*columns), ["l_suppkey"], [], functions).drop("l_suppkey")
