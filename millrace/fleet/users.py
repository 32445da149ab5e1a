"""User records: quotas from settings, unique insert, patches, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an update changes.
PASSWORD, MAX_CORES, MAX_MEMORY, MAX_CORES_AND_MEMORY = 1, 2, 3, 4


def setting_as_int(settings: Column, key: str) -> Column:
    """A 32-bit decimal number from a settings map, 0 when absent or not one."""
    text = F.try_element_at(settings, F.lit(key))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(number, F.lit(0))


def quotas(requests: DataFrame) -> DataFrame:
    """Core and memory quotas of user requests with a ``sets`` map."""
    return requests.withColumns(
        {
            "maxcores": setting_as_int(F.col("sets"), "maxcores"),
            "maxmemory": setting_as_int(F.col("sets"), "maxmemory"),
        }
    )


def insert_unique(requests: DataFrame, users: DataFrame, order: Sequence[str]) -> DataFrame:
    """Outcome of each request to create a user: names are unique.

    ``created`` for the first request (by ``order``, which must be unique per
    request) of a name not taken yet, ``exists`` for names taken before,
    ``duplicate`` for later requests of a name created here.
    """
    winners = requests.groupBy("username").agg(F.min(F.struct(*order)).alias("__first"))
    taken = users.select("username").distinct().withColumn("__taken", F.lit(True))
    return (
        requests.join(winners.join(taken, "username", "left"), "username")
        .withColumn(
            "outcome",
            F.when(F.col("__taken"), "exists")
            .when(F.struct(*order) == F.col("__first"), "created")
            .otherwise("duplicate"),
        )
        .drop("__first", "__taken")
    )


def password_digest(salt: Column, password: Column) -> Column:
    """Passwords are only ever held as a salted digest."""
    return F.sha2(F.concat(salt, password), 256)


def apply_patches(users: DataFrame, patches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Users after a set of updates, with the number of updates each received.

    A patch has a ``username``, a ``mode`` and new values. Only the values its mode
    names are used, and a zero or empty value leaves the stored one. Of several
    patches to one value the last by ``order`` holds. Patches of unknown users
    change nothing; every patch of a known mode moves ``uptime``.
    """

    def newest(value: Column, *modes: int) -> Column:
        usable = F.col("mode").isin(*modes) & value.isNotNull()
        return F.max_by(value, F.when(usable, F.struct(*order)))

    cores, memory = (F.nullif(F.col(c), F.lit(0)) for c in ("maxcores", "maxmemory"))
    password = F.nullif(F.col("password_digest"), F.lit(""))
    known = F.col("mode").isin(PASSWORD, MAX_CORES, MAX_MEMORY, MAX_CORES_AND_MEMORY)
    changes = (
        patches.filter(known)
        .groupBy("username")
        .agg(
            newest(cores, MAX_CORES, MAX_CORES_AND_MEMORY).alias("__cores"),
            newest(memory, MAX_MEMORY, MAX_CORES_AND_MEMORY).alias("__memory"),
            newest(password, PASSWORD).alias("__password"),
            F.max_by("ts", F.struct(*order)).alias("__ts"),
            F.count("*").alias("__n"),
        )
    )
    joined = users.join(changes, "username", "left")
    return joined.select(
        "username",
        F.coalesce("__cores", "maxcores").alias("maxcores"),
        F.coalesce("__memory", "maxmemory").alias("maxmemory"),
        F.coalesce("__password", "password_digest").alias("password_digest"),
        F.coalesce("__ts", "uptime").alias("uptime"),
        F.coalesce("__n", F.lit(0)).alias("updates"),
    )


def audit(usage: DataFrame, users: DataFrame) -> DataFrame:
    """Usage per user against the quotas; a quota of 0 means none."""
    total = usage.groupBy("username").agg(
        F.sum("cores").alias("cores"), F.sum("memory").alias("memory")
    )

    def over(used: str, quota: str) -> Column:
        return F.coalesce((F.col(quota) > 0) & (F.col(used) > F.col(quota)), F.lit(False))

    return total.join(users, "username", "left").select(
        "username",
        "cores",
        "memory",
        F.coalesce("maxcores", F.lit(0)).alias("maxcores"),
        F.coalesce("maxmemory", F.lit(0)).alias("maxmemory"),
        over("cores", "maxcores").alias("over_cores"),
        over("memory", "maxmemory").alias("over_memory"),
    )
