"""Streaming jobs: messages are written as JSON lines, streamed, and read back."""

from pyspark.sql import functions as F

from millrace.plans import fleet_inputs as inputs
from millrace.plans.registry import query
from millrace.streaming import messages
from millrace.workdir import fresh_path


def _arrived(t):
    path = fresh_path(t.spark, "messages")
    inputs.message_texts(t).write.text(path)
    return path


@query(
    "stream_route_messages",
    f"""WITH {inputs.CREATED_SQL}, {inputs.SERVICES_SQL},
        delivered AS (SELECT *, unnest(CASE WHEN twice THEN [1, 2] ELSE [1] END) AS nth FROM services),
        broken AS (SELECT *, unnest(CASE WHEN twice THEN [1, 2] ELSE [1] END) AS nth FROM created WHERE cut)
        SELECT 'routed' AS outcome, name, uid, servicename, servicetype, serviceport, routepath,
               NULL::VARCHAR AS raw
        FROM delivered WHERE NOT cut
        UNION ALL
        SELECT 'dead', NULL, NULL, NULL, NULL, NULL, NULL,
               substr('{{"name":"' || name || '","namespace":"spark-jobs"', 1, 40) FROM broken""",
)
def stream_route_messages(t):
    sink = fresh_path(t.spark, "routed")
    stream = messages.routed(messages.read_messages(t.spark, _arrived(t)))
    messages.run_to_path(stream, sink, fresh_path(t.spark, "checkpoint"), ["outcome"])
    return t.spark.read.parquet(sink).select(
        "outcome", "name", "uid", "servicename", "servicetype", "serviceport", "routepath", "raw"
    )


@query(
    "stream_redelivery_dedup",
    f"""WITH {inputs.CREATED_SQL}
        SELECT name, uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
               CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS services
        FROM created WHERE NOT cut""",
)
def stream_redelivery_dedup(t):
    sink = fresh_path(t.spark, "once")
    stream = messages.first_delivery(messages.read_messages(t.spark, _arrived(t)), "40 days")
    messages.run_to_path(stream, sink, fresh_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(sink).select(
        "name",
        "uid",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.size("services").alias("services"),
    )
