"""Names, paths and addresses derived from an engine's namespace and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and keys other programs rely on.
ENGINE_NAMESPACE = "spark-jobs"
ENGINE_PREFIX = "spark-sql-"
DEFAULT_USER = "default"
JDBC_PORT = 10019
JDBC_PORT_KEY = "spark.thrift.jdbc.bind.port"
WEB_RULE = "Host(`%s`) && PathPrefix(`%s`)"
TCP_RULE = "HostSNI(`*`)"
WEB_KIND, TCP_KIND = "IngressRoute", "IngressRouteTCP"


def engine_name(user: Column) -> Column:
    """``spark-sql-<user>``; an empty or missing user is the default user."""
    return F.concat(
        F.lit(ENGINE_PREFIX), F.coalesce(F.nullif(user, F.lit("")), F.lit(DEFAULT_USER))
    )


def ui_service(name: Column) -> Column:
    return F.concat(name, F.lit("-ui-svc"))


def jdbc_service(name: Column) -> Column:
    return F.concat(name, F.lit("-jdbc-svc"))


def _path(root: str, namespace: Column, name: Column) -> Column:
    known = (F.coalesce(namespace, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    return F.when(known, F.concat_ws("/", F.lit(root), namespace, name)).otherwise(F.lit(""))


def ui_path(namespace: Column, name: Column) -> Column:
    return _path("/proxy/spark", namespace, name)


def jdbc_path(namespace: Column, name: Column) -> Column:
    return _path("/proxy/spark-jdbc", namespace, name)


def ui_url(namespace: Column, name: Column, domain: str, https: bool = False) -> Column:
    scheme = "https" if https else "http"
    return F.concat(F.lit(f"{scheme}://spark.{domain}"), ui_path(namespace, name))


def jdbc_url(name: Column, conf: Column) -> Column:
    """The JDBC address of an engine that has the port key set, else ``null`` as text."""
    url = F.concat(F.lit("jdbc:hive2://"), jdbc_service(name), F.lit(f":{JDBC_PORT}"))
    has_port = F.coalesce(F.map_contains_key(conf, JDBC_PORT_KEY), F.lit(False))
    return F.when(has_port, url).otherwise(F.lit("null"))
