"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime SQL settings. Timestamps in the tables carry no zone, so sessions run
# in UTC; skewed joins must be split even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.mergeSchema": "false",
    "spark.sql.hive.metastorePartitionPruning": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark's own sizes, whatever an earlier job of the session has set.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # State of a stream lives on disk next to the executor, not on its heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

SHUFFLE_PARTITION_BYTES = 256 * 1024 * 1024


def tune(spark: SparkSession, shuffle_bytes: int = 0) -> SparkSession:
    """Apply the runtime settings to a session someone else has built.

    On a cluster, shuffles start with enough partitions for all cores and for
    ``shuffle_bytes``, the size of the largest shuffle expected; AQE merges those
    that turn out small but splits none except in skewed joins.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not context.master.startswith("local"):
        partitions = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            4 * context.defaultParallelism,
            shuffle_bytes // SHUFFLE_PARTITION_BYTES,
        )
        initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        spark.conf.set(initial, str(partitions))
    return spark


def local_session(app: str = "millrace", cores: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    cores = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
