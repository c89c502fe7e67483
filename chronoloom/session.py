"""Session helpers: the settings the engine wants, and lineage cuts that survive executor loss."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "chronoloom", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, skew joins and Arrow on. A cluster normally hands in its own session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # checkpoint files go when the frames that use them are gone
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call-site capture costs several driver round trips per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names: the one place that driver and executors all read and write."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute `df` once for its many readers: in the reliable checkpoint folder, or on the executors' disks if there is none.

    Without a folder the lineage stays, so blocks lost with an executor are computed again.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, tag: str = "scratch") -> str:
    """A new path for a written table: in the shared folder, or, in a local session that names none, in the warehouse."""
    root = shared_folder(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/chronoloom-scratch"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write `df` as Parquet to a scratch path and read it back: a lineage cut with sizes that the optimizer can see."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
