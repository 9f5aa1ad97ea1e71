"""Session helpers: a local session for tests and benches, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def local_session(cpus: int | str = 8, app: str = "normatile", **conf) -> SparkSession:
    """A single-JVM session for tests and benches. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The session's ``spark.checkpoint.dir`` (or a directory already set on the context) wins. Only a
    local session may fall back to a temporary folder: on a cluster that folder would exist on one
    machine only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="normatile-")
    return _local_root


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Used where a value must not change when a lost task is recomputed (partition numbers), where a
    costly result is read by more than one branch of a plan, and to cut lineage in loops. Being a
    parquet table it keeps column pruning, and its known size lets Spark pick broadcast joins only
    when the table really is small.
    """
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Folders ``path/<column>=<value>`` that were written to their end: their paths by value.

    The writer's ``_SUCCESS`` file, put there last, is the record of the commit; a folder without it is
    what a failed write left and does not count. Only names are listed, on any file system Spark reaches.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{column}=*")) or []:
        folder = status.getPath()
        if system.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found[folder.getName().split("=", 1)[1]] = folder.toString()
    return found
