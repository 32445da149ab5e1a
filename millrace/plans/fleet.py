"""Fleet analytics on engines, users and routes derived from ``events``."""

from pyspark.sql import functions as F

from millrace.fleet import conf, naming, routes, status, users
from millrace.plans import fleet_inputs as inputs
from millrace.plans.registry import query

_NOW = f"TIMESTAMP '{inputs.AS_OF}'"


def _age_sql(column):
    seconds = f"(epoch_us({_NOW}) - epoch_us({column})) // 1000000"
    return f"""CASE WHEN {column} IS NULL THEN 'N.A.'
        WHEN {seconds} < 60 THEN {seconds} || 's'
        WHEN {seconds} < 3600 THEN {seconds} // 60 || 'm'
        WHEN {seconds} < 86400 THEN {seconds} // 3600 || 'h'
        WHEN {seconds} < 31536000 THEN {seconds} // 86400 || 'd'
        ELSE {seconds} // 31536000 || 'y' END"""


@query(
    "fleet_status",
    f"""WITH {inputs.APPS_SQL}
        SELECT namespace, name, state, {_age_sql("submission_ts")} AS submission_age,
               {_age_sql("termination_ts")} AS termination_age,
               'http://spark.{inputs.DOMAIN}/proxy/spark/' || namespace || '/' || name AS driver_url,
               CASE WHEN has_jdbc THEN 'jdbc:hive2://' || name || '-jdbc-svc:10019' ELSE 'null' END AS jdbc_svc
        FROM apps""",
)
def fleet_status(t):
    return status.fleet_status(inputs.apps(t), inputs.as_of(), inputs.DOMAIN)


@query(
    "fleet_state_lookup",
    f"""WITH {inputs.APPS_SQL},
        asked AS (SELECT o_custkey, 'spark-sql-' || CASE WHEN o_custkey % 7 = 0 THEN 'default'
                         ELSE CAST(o_custkey % 200 AS VARCHAR) END AS name FROM orders)
        SELECT asked.o_custkey, asked.name, 'spark-jobs' AS namespace, state, error_message AS message,
               state IS NOT NULL AS found
        FROM asked LEFT JOIN apps ON asked.name = apps.name""",
)
def fleet_state_lookup(t):
    key = F.col("o_custkey")
    user = F.when(key % 7 == 0, "").otherwise((key % 200).cast("string"))
    requests = t.orders.select("o_custkey", user.alias("user"))
    return status.state_lookup(requests, inputs.apps(t)).select(
        "o_custkey", "name", "namespace", "state", "message", "found"
    )


@query(
    "engine_get_or_create",
    f"""WITH {inputs.APPS_SQL},
        asked AS (SELECT o_orderkey, 'spark-sql-' || CASE WHEN o_custkey % 7 = 0 THEN 'default'
                         ELSE CAST(o_custkey % 200 AS VARCHAR) END AS name FROM orders)
        SELECT a.name, min(o_orderkey) AS first_request, count(*) AS requests,
               a.name || '-jdbc-svc' AS service, 'tcp' AS service_type, 'hive2' AS entry_point,
               CASE WHEN any_value(apps.name) IS NULL THEN 'created' ELSE 'reused' END AS origin
        FROM asked a LEFT JOIN apps ON a.name = apps.name GROUP BY a.name""",
)
def engine_get_or_create(t):
    key = F.col("o_custkey")
    user = F.when(key % 7 == 0, "").otherwise((key % 200).cast("string"))
    requests = t.orders.select("o_orderkey", user.alias("user"))
    return status.get_or_create(requests, inputs.apps(t), ["o_orderkey"]).select(
        "name",
        F.col("o_orderkey").alias("first_request"),
        "requests",
        "service",
        "service_type",
        "entry_point",
        "origin",
    )


@query(
    "resource_resolve",
    """SELECT event_id,
              CAST(coalesce(nullif(user_id % 4, 0), 1) AS INTEGER) AS driver_cores,
              coalesce(nullif(user_id % 4, 0), 1) * 1100 || 'm' AS driver_core_limit,
              CASE WHEN event_id % 2 = 0 THEN '2g' ELSE '512m' END AS driver_mem,
              CAST(coalesce(nullif(user_id % 3, 0), 1) AS INTEGER) AS executor_cores,
              coalesce(nullif(user_id % 3, 0), 1) * 1100 || 'm' AS executor_core_limit,
              '512m' AS executor_mem
       FROM events""",
)
def resource_resolve(t):
    user = F.col("user_id").cast("int")
    requests = t.events.select(
        "event_id",
        F.nullif(user % 4, F.lit(0)).alias("driver_cores"),
        F.when(F.col("event_id") % 2 == 0, "2g").alias("driver_mem"),
        F.nullif(user % 3, F.lit(0)).alias("executor_cores"),
        F.lit(None).cast("string").alias("executor_mem"),
    )
    return conf.resolve_resources(requests)


# Settings every engine starts with.
_BASE_CONF = {
    "spark.sql.parquet.mergeSchema": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.hive.metastorePartitionPruning": "true",
}
_ENGINE_CONF = {"spark.sql.engine": "true", naming.JDBC_PORT_KEY: str(naming.JDBC_PORT)}


@query(
    "conf_overlay",
    """SELECT event_id, key, value FROM (
         SELECT event_id, unnest(['spark.sql.parquet.mergeSchema', 'spark.sql.parquet.filterPushdown',
                  'spark.sql.hive.metastorePartitionPruning', 'spark.sql.engine',
                  'spark.thrift.jdbc.bind.port', 'spark.executor.cores']) AS key,
                unnest([CASE WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END, 'true', 'true', 'true',
                  '10019', CAST(user_id % 5 AS VARCHAR)]) AS value
         FROM events)""",
)
def conf_overlay(t):
    user = F.col("user_id")
    extra = F.map_from_arrays(
        F.array(
            F.lit("spark.executor.cores"),
            F.lit("executor.memory"),
            F.when(user % 3 == 0, "spark.sql.parquet.mergeSchema").otherwise("mergeSchema"),
        ),
        F.array((user % 5).cast("string"), F.lit("2g"), F.lit("true")),
    )
    engine = conf.constant_map({**_BASE_CONF, **_ENGINE_CONF})
    return t.events.select("event_id", F.explode(conf.overlay(engine, extra)).alias("key", "value"))


@query(
    "quota_settings",
    """SELECT event_id, CASE user_id % 6 WHEN 1 THEN 4 WHEN 4 THEN -3 ELSE 0 END AS maxcores,
              CAST(CASE WHEN user_id % 6 = 0 THEN 0 ELSE 512 * (user_id % 4) END AS INTEGER) AS maxmemory
       FROM events""",
)
def quota_settings(t):
    # A number, one in spaces, a word, a negative one, one past 32 bits; or no settings.
    case = (F.col("user_id") % 6).cast("int")
    cores = F.element_at(F.array(*[F.lit(s) for s in ("4", " 4 ", "x", "-3", "99999999999")]), case)
    memory = F.concat(F.lit("+"), 512 * (F.col("user_id") % 4))
    sets = F.when(
        case > 0, F.create_map(F.lit("maxcores"), F.when(case > 0, cores), F.lit("maxmemory"), memory)
    )
    return users.quotas(t.events.select("event_id", sets.alias("sets"))).drop("sets")


@query(
    "user_insert_unique",
    """WITH asked AS (SELECT event_id, 'user_' || user_id AS username, user_id FROM events),
            won AS (SELECT username, min(event_id) AS first FROM asked GROUP BY username)
       SELECT event_id, asked.username,
              CASE WHEN user_id % 3 = 0 THEN 'exists' WHEN event_id = first THEN 'created'
                   ELSE 'duplicate' END AS outcome
       FROM asked JOIN won USING (username)""",
)
def user_insert_unique(t):
    name = F.concat(F.lit("user_"), "user_id").alias("username")
    asked = t.events.select("event_id", name)
    existing = t.events.filter(F.col("user_id") % 3 == 0).select(name)
    return users.insert_unique(asked, existing, ["event_id"]).select("event_id", "username", "outcome")


@query(
    "user_patch_update",
    f"""WITH {inputs.USERS_SQL},
        patches AS (SELECT 'user_' || user_id AS username, event_id, ts,
                           CAST(event_id % 6 AS INTEGER) AS mode,
                           CAST(event_id % 4 AS INTEGER) AS maxcores,
                           CAST(256 * (event_id % 3) AS INTEGER) AS maxmemory
                    FROM events WHERE user_id % 5 <> 1),
        changes AS (SELECT username,
               arg_max(maxcores, (ts, event_id)) FILTER (WHERE mode IN (2, 4) AND maxcores <> 0) AS cores,
               arg_max(maxmemory, (ts, event_id)) FILTER (WHERE mode IN (3, 4) AND maxmemory <> 0) AS memory,
               count(*) FILTER (WHERE mode = 1) > 0 AS password,
               max(ts) AS ts, count(*) AS n
               FROM patches WHERE mode BETWEEN 1 AND 4 GROUP BY username)
        SELECT username, coalesce(cores, maxcores) AS maxcores, coalesce(memory, maxmemory) AS maxmemory,
               coalesce(password, false) AS password_changed,
               strftime(coalesce(ts, uptime), '%Y-%m-%d %H:%M:%S') AS uptime, coalesce(n, 0) AS updates
        FROM users LEFT JOIN changes USING (username)""",
)
def user_patch_update(t):
    event = F.col("event_id")
    patches = t.events.filter(F.col("user_id") % 5 != 1).select(
        F.concat(F.lit("user_"), "user_id").alias("username"),
        "event_id",
        "ts",
        (event % 6).cast("int").alias("mode"),
        (event % 4).cast("int").alias("maxcores"),
        (256 * (event % 3)).cast("int").alias("maxmemory"),
        users.password_digest(event.cast("string"), F.col("props")).alias("password_digest"),
    )
    return users.apply_patches(inputs.users(t), patches, ["ts", "event_id"]).select(
        "username",
        "maxcores",
        "maxmemory",
        F.col("password_digest").isNotNull().alias("password_changed"),
        F.date_format("uptime", "yyyy-MM-dd HH:mm:ss").alias("uptime"),
        "updates",
    )


@query(
    "quota_audit",
    f"""WITH {inputs.USERS_SQL},
        used AS (SELECT 'user_' || user_id AS username, count(*) AS cores,
                        CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS memory
                 FROM events GROUP BY user_id)
        SELECT username, cores, memory, maxcores, maxmemory,
               maxcores > 0 AND cores > maxcores AS over_cores,
               maxmemory > 0 AND memory > maxmemory AS over_memory
        FROM used JOIN users USING (username)""",
)
def quota_audit(t):
    usage = t.events.select(
        F.concat(F.lit("user_"), "user_id").alias("username"),
        F.lit(1).alias("cores"),
        F.get_json_object("props", "$.k").cast("int").alias("memory"),
    )
    return users.audit(usage, inputs.users(t))


@query(
    "route_table",
    f"""WITH {inputs.CREATED_SQL}, {inputs.SERVICES_SQL}
        SELECT 'spark-jobs' AS namespace, name AS owner, uid, servicename AS service, serviceport AS port,
               entrypoint AS entry_point,
               CASE servicetype WHEN 'web' THEN 'IngressRoute' ELSE 'IngressRouteTCP' END AS kind,
               CASE servicetype WHEN 'web'
                    THEN 'Host(`spark.{inputs.DOMAIN}`) && PathPrefix(`' || routepath || '`)'
                    ELSE 'HostSNI(`*`)' END AS rule
        FROM services WHERE servicetype IN ('web', 'tcp')""",
)
def route_table(t):
    return routes.route_table(inputs.messages(t), inputs.DOMAIN)
