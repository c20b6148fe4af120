"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Suggested session settings. Partition counts stay with the cluster; AQE
# coalesces and splits shuffle partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lists of ids up to this length reach the Parquet pages one by one, longer ones as a range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.ui.enabled": "false",
    # Call sites of single column operations are not recorded: building the longer
    # expressions takes a fraction of the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "docloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set a temporary folder is used, in local mode only: on a cluster every
    machine would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="docloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is on."""
    handle = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    handle, fs = hadoop_path(spark, path)
    return fs.exists(handle)


def is_folder(spark: SparkSession, path: str) -> bool:
    handle, fs = hadoop_path(spark, path)
    return fs.exists(handle) and fs.getFileStatus(handle).isDirectory()


def delete_path(spark: SparkSession, path: str) -> None:
    handle, fs = hadoop_path(spark, path)
    fs.delete(handle, True)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The N of all folders ``name=N`` below ``path``; none where it does not exist."""
    handle, fs = hadoop_path(spark, path)
    if not fs.exists(handle):
        return []
    names = [f.getPath().getName().rpartition("=")[2] for f in fs.listStatus(handle) if f.isDirectory()]
    return [int(n) for n in names if n.isdigit()]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark has finished writing the folder."""
    return path_exists(spark, f"{path}/_SUCCESS")


def complete_numbers(spark: SparkSession, path: str, name: str = "seq") -> set[int]:
    """Those ``numbers`` whose folder ``name=N`` Spark has finished writing."""
    return {n for n in numbers(spark, path) if complete(spark, f"{path}/{name}={n}")}
