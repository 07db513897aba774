"""Shared folder, tables and small column helpers of the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts of the operators define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder if all runs in the driver's process, else an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataslide-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the folder is scratch
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/strataslide/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(kept: DataFrame) -> None:
    """Remove what keep() wrote, once nothing reads it any more; a failed removal waits for the process's end."""
    for file in kept.inputFiles()[:1]:
        _drop(kept.sparkSession, file.rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, each: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """mapInPandas where `ids`, longs in df or in the schema, travel as text: pandas rounds a column of longs that holds nulls."""
    sent = df.withColumns({c: F.col(c).cast("long").cast("string") for c in ids if c in df.columns})
    out = T.StructType.fromDDL(schema)
    told = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ids else f for f in out])
    found = sent.mapInPandas(each, told)
    return found.select(*[F.col(f.name).cast("long").alias(f.name) if f.name in ids else f.name for f in out])


def give_back() -> None:
    """Memory that this process's allocators hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(each: Callable) -> Callable:
    """A function of batches that gives unused memory back after each one: workers outlive their tasks, and a batch of long texts leaves some 100 MB in each."""

    def run(batches: Iterator) -> Iterator:
        for b in each(batches):
            yield b
            del b
            give_back()
        give_back()

    return run


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text) -> F.Column:
    """Number of words in a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
