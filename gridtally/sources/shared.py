"""Scratch tables in the folder the session shares between executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_REMOVED_AT_END: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    On a single machine (master ``local``) without either it is the warehouse folder. On a cluster
    there is no folder to fall back on that every executor can surely reach, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir")
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one. It is removed when the driver's session ends."""
    top = f"{shared_root(spark).rstrip('/')}/gridtally-{spark.sparkContext.applicationId}"
    if top not in _REMOVED_AT_END:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _REMOVED_AT_END.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregate once and go on from the stored table.

    For a small result of a large job that is read several times: the job runs once, its
    lineage ends here, a lost executor costs nothing, and the planner knows the size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
