"""Current state of the engines, and look-ups by user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.fleet import naming

_MINUTE, _HOUR, _DAY, _YEAR = 60, 3600, 86400, 365 * 86400


def age_text(since: Column, as_of: Column) -> Column:
    """Whole units of the largest unit that fits, ``N.A.`` without a time.

    A clock that runs up to two seconds ahead counts as now; further ahead the
    age is invalid.
    """
    micros = F.unix_micros(as_of.cast("timestamp_ltz")) - F.unix_micros(since.cast("timestamp_ltz"))
    # Whole seconds, cut towards zero.
    seconds = F.expr("bigint(0)") + F.when(micros < 0, -F.floor(-micros / 1_000_000)).otherwise(
        F.floor(micros / 1_000_000)
    )

    def units(size: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(letter))

    return (
        F.when(since.isNull(), "N.A.")
        .when(seconds < -1, "<invalid>")
        .when(seconds < 0, "0s")
        .when(seconds < _MINUTE, units(1, "s"))
        .when(seconds < _HOUR, units(_MINUTE, "m"))
        .when(seconds < _DAY, units(_HOUR, "h"))
        .when(seconds < _YEAR, units(_DAY, "d"))
        .otherwise(units(_YEAR, "y"))
    )


def latest(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record per key. ``max_by`` keeps one record per key and task, so
    an engine with most of the records costs no more than any other."""
    rest = [c for c in records.columns if c not in key]
    return (
        records.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select(*key, "r.*")
    )


def fleet_status(
    apps: DataFrame, as_of: Column, domain: str, https: bool = False, order: Sequence[str] = ("submission_ts",)
) -> DataFrame:
    """One line per engine, from its last record by ``order``: state, ages, UI address, JDBC address."""
    columns = ["namespace", "name", "state", "submission_ts", "termination_ts", "conf"]
    records = apps.select(*columns, *[c for c in order if c not in columns])
    return latest(records, ["namespace", "name"], list(order)).select(
        "namespace",
        "name",
        "state",
        age_text(F.col("submission_ts"), as_of).alias("submission_age"),
        age_text(F.col("termination_ts"), as_of).alias("termination_age"),
        naming.ui_url(F.col("namespace"), F.col("name"), domain, https).alias("driver_url"),
        naming.jdbc_url(F.col("name"), F.col("conf")).alias("jdbc_svc"),
    )


def state_lookup(requests: DataFrame, apps: DataFrame, order: Sequence[str] = ("submission_ts",)) -> DataFrame:
    """State and message of each requesting user's engine; ``found`` tells a miss.

    Of several records of an engine the last by ``order`` counts.
    """
    asked = requests.withColumn("name", naming.engine_name(F.col("user")))
    records = apps.filter(F.col("namespace") == naming.ENGINE_NAMESPACE)
    records = records.select("name", "state", "error_message", *order)
    known = latest(records, ["name"], list(order)).select(
        "name", "state", F.col("error_message").alias("message"), F.lit(True).alias("found")
    )
    return (
        asked.join(known, "name", "left")
        .withColumn("namespace", F.lit(naming.ENGINE_NAMESPACE))
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def get_or_create(requests: DataFrame, apps: DataFrame, order: list[str]) -> DataFrame:
    """The engine each requesting user ends up with: the running one, else a new one.

    Several requests of one user create a single engine, from the first by
    ``order``.
    """
    asked = requests.withColumn("name", naming.engine_name(F.col("user")))
    rest = [c for c in asked.columns if c != "name"]
    first = (
        asked.groupBy("name")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count("*").alias("requests"))
        .select("name", "requests", "r.*")
    )
    running = (
        apps.filter(F.col("namespace") == naming.ENGINE_NAMESPACE)
        .select("name", F.lit(True).alias("running"))
        .distinct()
    )
    return first.join(running, "name", "left").select(
        *first.columns,
        F.lit(naming.ENGINE_NAMESPACE).alias("namespace"),
        naming.jdbc_service(F.col("name")).alias("service"),
        F.lit("tcp").alias("service_type"),
        F.lit("hive2").alias("entry_point"),
        F.when(F.col("running"), "reused").otherwise("created").alias("origin"),
    )
