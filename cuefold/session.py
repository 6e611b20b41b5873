"""Session helpers: sane defaults for local runs and a durable lineage cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cuefold", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session submit gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CUEFOLD_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cuefold-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there.

    Unlike a cached block the table survives lost executors, later reads prune its columns, and
    its file sizes tell the planner how large it is.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuefold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete durable tables that nothing will read again: those a later round has replaced.

    Only what `durable` gave itself is deleted, not what was derived of it.
    """
    for path, spark in ((getattr(t, "_durable_path", None), t.sparkSession) for t in tables if t is not None):
        if path is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in as many partitions as the session shuffles into.

    For work that costs time rather than bytes: adaptive execution would merge partitions that are
    small in bytes into a few long tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
