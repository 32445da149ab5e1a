"""Resources and configuration an engine starts with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request leaves out.
DEFAULT_CORES = 1
DEFAULT_MEMORY = "512m"
MILLIS_PER_CORE = 1100


def core_limit(cores: Column) -> Column:
    return F.concat((cores.cast("int") * MILLIS_PER_CORE).cast("string"), F.lit("m"))


def resolve_resources(requests: DataFrame) -> DataFrame:
    """Fill in cores and memory, and derive the core limits from the cores."""
    driver = F.coalesce("driver_cores", F.lit(DEFAULT_CORES))
    executor = F.coalesce("executor_cores", F.lit(DEFAULT_CORES))
    return requests.withColumns(
        {
            "driver_cores": driver,
            "driver_core_limit": core_limit(driver),
            "driver_mem": F.coalesce("driver_mem", F.lit(DEFAULT_MEMORY)),
            "executor_cores": executor,
            "executor_core_limit": core_limit(executor),
            "executor_mem": F.coalesce("executor_mem", F.lit(DEFAULT_MEMORY)),
        }
    )


def constant_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def overlay(base: Column, extra: Column, prefix: str = "spark.") -> Column:
    """``base`` with the entries of ``extra`` whose key has the prefix; they win."""
    taken = F.map_filter(
        F.coalesce(extra, F.create_map().cast("map<string,string>")),
        lambda k, v: k.startswith(prefix),
    )
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(taken, k))
    return F.map_concat(kept, taken)
