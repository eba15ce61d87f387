"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Where the session has no such setting, a local one (a test) gets a temporary folder; a cluster raises.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            own = tempfile.mkdtemp(prefix="siftflow-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _LOCAL[context.applicationId] = f"file://{own}"
        path = _LOCAL[context.applicationId]
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """A path as the JVM has it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is there when the application ends goes."""
    path = f"{shared_folder(spark)}/siftflow/{name}-{uuid.uuid4().hex}"
    where, files = file_system(spark, path)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    files.delete(where, True)
