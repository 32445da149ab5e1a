"""Where jobs put tables they must materialise: sinks, snapshots, cut lineage.

On a cluster this is a folder per application below the shared one named by
``spark.checkpoint.dir``; it can go when the application has ended. Only a local
session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}  # application id -> folder, local sessions only


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None)
    if root:
        return f"{root.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"
    master = spark.sparkContext.master
    # Executors of local-cluster[…] are processes of their own, as on any cluster.
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_roots[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else writes to."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def fresh_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, so whatever was
    computed once (partition placement, samples) stays the same for every reader.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
