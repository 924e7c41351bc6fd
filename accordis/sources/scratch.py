"""Folders for what a job writes on its way, in the one that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folders to delete at the end, with the file system to do it by: that one outlives the session.
_MADE: dict[str, tuple[Any, Any]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder is made only on a local master where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="accordis-"))
    return str(found).rstrip("/")


def new_folder(spark: SparkSession, name: str = "") -> str:
    """The name of a folder that nobody has, below the shared one. It goes when Python ends, or by remove()."""
    path = f"{shared_dir(spark)}/accordis/{name or uuid.uuid4().hex}"
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    _MADE[path] = at.getFileSystem(context._jsc.hadoopConfiguration()), at
    return path


def remove(path: str) -> None:
    """Delete a folder of new_folder(). Works after the session has stopped, as long as its JVM is there."""
    files, at = _MADE.pop(path)
    files.delete(at, True)


def remove_all() -> None:
    """Delete all folders of new_folder(). Runs at exit; call it earlier once nothing lazy reads them."""
    for path in list(_MADE):
        try:
            remove(path)
        except Exception:  # noqa: BLE001  the JVM is gone: nothing can be done from here
            continue


atexit.register(remove_all)


def cut(df: DataFrame) -> DataFrame:
    """df written into the shared folder and read back, so lineage ends there. What is read is as large as its files: a checkpoint would
    keep the estimate of its plan, a product over joins whose digits double with each self-join of a loop."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete what cut() wrote for tables that nothing lazy reads any more. What isn't released goes when Python ends."""
    for table in tables:
        remove(table._written_at)
