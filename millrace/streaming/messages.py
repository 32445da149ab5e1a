"""The stream of "application created" messages: JSON text in, route rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICE = (
    "struct<servicename string, servicetype string, entrypoint string, serviceport int,"
    " targetport int, serviceip string, routepath string>"
)
# The array arrives under its Go field name: the tag meant to rename it is malformed.
MESSAGE = f"name string, namespace string, uid string, ts timestamp, ExtraServices array<{SERVICE}>"
_BAD = "_bad"


def decode(text: DataFrame, column: str = "value") -> DataFrame:
    """Parse messages; ``bad`` marks text that is not a message object.

    Keeps the raw text, the file it came in and when it arrived. Rows are ``raw, file,
    arrived, bad, name, namespace, uid, ts, services``.
    """
    schema = f"{MESSAGE}, {_BAD} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = F.from_json(F.col(column), schema, options)
    return text.select(F.col(column).alias("raw"), "file", "arrived", parsed.alias("m")).select(
        "raw",
        "file",
        "arrived",
        (F.col("m").isNull() | F.col(f"m.{_BAD}").isNotNull()).alias("bad"),
        "m.name",
        "m.namespace",
        "m.uid",
        "m.ts",
        F.col("m.ExtraServices").alias("services"),
    )


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """Messages, one per line, from text files arriving under ``path``; ``arrived`` is when their batch began.

    That is the stream's own clock: it is part of a batch's log, so a batch that is run again has the same time, and it
    goes forward whatever dates the files bear.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.current_timestamp().alias("arrived"),
    )


def routed(messages: DataFrame) -> DataFrame:
    """One row per announced service, and one per message that cannot be decoded.

    Both kinds leave in one stream, told apart by ``outcome``, so the source is
    read once and a file sink partitioned by ``outcome`` keeps them in folders of
    their own. A good message without services leaves no row.
    """
    decoded = decode(messages)
    placeholder = F.array(F.lit(None).cast(SERVICE))
    services: Column = F.when(F.col("bad"), placeholder).otherwise(F.col("services"))
    return decoded.select("*", F.explode(services).alias("s")).select(
        F.when(F.col("bad"), "dead").otherwise("routed").alias("outcome"),
        F.when(F.col("bad"), F.col("raw")).alias("raw"),
        "namespace",
        "name",
        "uid",
        "s.servicename",
        "s.servicetype",
        "s.entrypoint",
        "s.serviceport",
        "s.routepath",
    )


def first_delivery(messages: DataFrame, horizon: str, ways: int = 16) -> DataFrame:
    """Good messages, each ``uid`` once however often it was delivered.

    ``horizon`` is how long after a delivery its repeat can arrive; state is kept that
    long and no longer. Messages need no time of their own: what counts is when they
    are read, so files that bear old dates (copied, uploaded late) are never too late. Those without
    a uid carry nothing to match on and are passed on by ``routed`` only.

    Deliveries are first matched within ``ways`` groups of files, so that even one
    uid sent millions of times is spread over tasks; what is left, at most ``ways``
    of each uid, is matched across groups.
    """
    group = F.pmod(F.xxhash64("file"), F.lit(ways))
    return (
        decode(messages)
        .filter(~F.col("bad") & F.col("uid").isNotNull())
        .withColumn("file_group", group)
        .drop("raw", "bad", "file")
        .withWatermark("arrived", horizon)
        .dropDuplicatesWithinWatermark(["uid", "file_group"])
        .dropDuplicatesWithinWatermark(["uid"])
        .drop("file_group", "arrived")
    )


def run_to_path(
    stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None
) -> None:
    """Process what is available and stop; a restart continues at the checkpoint.

    The parquet file sink commits whole batches through its log, so every row is
    written exactly once even when a batch is run again.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
