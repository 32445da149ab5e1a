"""Fleet records derived from the ``events`` table, one engine per user.

Each derived frame has its DuckDB text next to it, so that query and oracle start
from the same records.
"""

from pyspark.sql import functions as F

from millrace.fleet import naming

AS_OF = "2024-02-01 12:00:00"
DOMAIN = "example.org"

APPS_SQL = """apps AS (
  SELECT 'spark-jobs' AS namespace, 'spark-sql-' || user_id AS name, user_id,
         arg_max(event_type, (ts, event_id)) AS state,
         'last value ' || arg_max(value, (ts, event_id)) AS error_message,
         min(ts) AS submission_ts,
         CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN max(ts) END AS termination_ts,
         user_id % 2 = 0 AS has_jdbc
  FROM events GROUP BY user_id)"""

USERS_SQL = """users AS (
  SELECT 'user_' || user_id AS username, CAST(user_id % 5 AS INTEGER) AS maxcores,
         CAST(512 * (user_id % 4) AS INTEGER) AS maxmemory, min(ts) AS uptime
  FROM events GROUP BY user_id)"""

# Per event a message with a web, a tcp and sometimes a udp
# service; every tenth event is delivered twice, every seventh is cut short.
CREATED_SQL = """created AS (
  SELECT event_id, user_id, ts, 'spark-sql-' || user_id AS name, 'uid-' || event_id AS uid,
         event_id % 7 = 0 AS cut, event_id % 10 = 0 AS twice
  FROM events)"""

SERVICES_SQL = """services AS (
  SELECT s.*, 'web' AS servicetype, 'web' AS entrypoint, name || '-ui-svc' AS servicename,
         4040 AS serviceport, '/proxy/spark/spark-jobs/' || name AS routepath FROM created s
  UNION ALL
  SELECT s.*, 'tcp', 'hive2', name || '-jdbc-svc', 10019,
         '/proxy/spark-jdbc/spark-jobs/' || name FROM created s
  UNION ALL
  SELECT s.*, 'udp', 'web', name || '-udp-svc', 53, '' FROM created s WHERE event_id % 3 = 0)"""


def apps(t):
    order = F.struct("ts", "event_id")
    jdbc = F.create_map(F.lit(naming.JDBC_PORT_KEY), F.lit(str(naming.JDBC_PORT)))
    none = F.create_map().cast("map<string,string>")
    latest_by_user = t.events.groupBy("user_id").agg(
        F.max_by(F.struct("event_type", "value", "ts"), order).alias("last"),
        F.min("ts").alias("submission_ts"),
    )
    return latest_by_user.select(
        F.lit(naming.ENGINE_NAMESPACE).alias("namespace"),
        naming.engine_name(F.col("user_id").cast("string")).alias("name"),
        "user_id",
        F.col("last.event_type").alias("state"),
        F.concat(F.lit("last value "), "last.value").alias("error_message"),
        "submission_ts",
        F.when(F.col("last.event_type") == "error", F.col("last.ts")).alias("termination_ts"),
        F.when(F.col("user_id") % 2 == 0, jdbc).otherwise(none).alias("conf"),
    )


def users(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("uptime")).select(
        F.concat(F.lit("user_"), "user_id").alias("username"),
        (F.col("user_id") % 5).cast("int").alias("maxcores"),
        (512 * (F.col("user_id") % 4)).cast("int").alias("maxmemory"),
        F.lit(None).cast("string").alias("password_digest"),
        "uptime",
    )


def _service(kind, entry, name, port, path):
    return F.struct(
        name.alias("servicename"),
        F.lit(kind).alias("servicetype"),
        F.lit(entry).alias("entrypoint"),
        F.lit(port).alias("serviceport"),
        F.lit(port).alias("targetport"),
        F.lit("").alias("serviceip"),
        path.alias("routepath"),
    )


def messages(t):
    """Events as decoded messages: name, namespace, uid, ts, services."""
    namespace = F.lit(naming.ENGINE_NAMESPACE)
    name = naming.engine_name(F.col("user_id").cast("string"))
    web = _service("web", "web", naming.ui_service(name), 4040, naming.ui_path(namespace, name))
    tcp = _service(
        "tcp", "hive2", naming.jdbc_service(name), naming.JDBC_PORT, naming.jdbc_path(namespace, name)
    )
    udp = _service("udp", "web", F.concat(name, F.lit("-udp-svc")), 53, F.lit(""))
    services = F.when(F.col("event_id") % 3 == 0, F.array(web, tcp, udp)).otherwise(F.array(web, tcp))
    return t.events.select(
        "event_id",
        name.alias("name"),
        namespace.alias("namespace"),
        F.concat(F.lit("uid-"), "event_id").alias("uid"),
        "ts",
        services.alias("services"),
    )


def message_texts(t):
    """The same messages as JSON lines, some cut short, some delivered twice."""
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(
        F.struct("name", "namespace", "uid", moment.alias("ts"), F.col("services").alias("ExtraServices"))
    )
    cut = F.col("event_id") % 7 == 0
    text = F.when(cut, F.substr(body, F.lit(1), F.lit(40))).otherwise(body)
    times = F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)
    return messages(t).select(text.alias("value"), F.explode(F.sequence(F.lit(1), times))).select("value")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")
