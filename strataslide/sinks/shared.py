"""A folder that driver and executors share, for files that a session makes for itself."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver's process ends. Where that is unset, a temporary folder if all runs in the driver's process, else an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataslide-"))
        at = context.getCheckpointDir()
    path = f"{at.rstrip('/')}/strataslide/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table below the shared folder: what several steps read is worked out once, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
