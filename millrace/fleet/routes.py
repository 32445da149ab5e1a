"""Proxy routes for the services an application announces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.fleet import naming


def route_table(messages: DataFrame, domain: str) -> DataFrame:
    """One rule per announced service: web by host and path, tcp by any SNI name.

    ``messages`` has name, namespace, uid and an array of services. Services of
    another type have no route.
    """
    services = messages.select("namespace", "name", "uid", F.explode("services").alias("s"))
    kind = F.col("s.servicetype")
    web = F.format_string(naming.WEB_RULE, F.lit(f"spark.{domain}"), F.coalesce("s.routepath", F.lit("")))
    return services.filter(kind.isin("web", "tcp")).select(
        "namespace",
        F.col("name").alias("owner"),
        "uid",
        F.col("s.servicename").alias("service"),
        F.col("s.serviceport").alias("port"),
        F.col("s.entrypoint").alias("entry_point"),
        F.when(kind == "web", naming.WEB_KIND).otherwise(naming.TCP_KIND).alias("kind"),
        F.when(kind == "web", web).otherwise(naming.TCP_RULE).alias("rule"),
    )
