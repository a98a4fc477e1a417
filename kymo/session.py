"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "kymo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE with skew handling.

    Nothing here fixes a partition count for a cluster: AQE coalesces from
    ``spark.sql.shuffle.partitions``, which the cluster sets.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone are read as UTC; shifts are explicit ``tz_offset`` values."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, the context's checkpoint folder counts. A local master has one
    machine, so its JVM's own folder will do there; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return f"{spark._jvm.java.lang.System.getProperty('java.io.tmpdir').rstrip('/')}/kymo-shared"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df):
    """Cut lineage on shared storage, so a lost executor does not replay the whole job."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialized(df, name: str = "stage"):
    """Write a frame that several passes will read to the shared folder and read it back:
    columnar, pruned per pass, and safe when an executor is lost."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/kymo-stage/{name}-{uuid.uuid4().hex}"


def clear_stage(spark: SparkSession) -> None:
    """Delete everything staged so far; results that still read it must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kymo-stage")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
