"""The folder that the driver and all executors share, and the size of the batches that Python gets."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with its limit on the bytes of an Arrow batch set to BATCH_BYTES unless the user has set one: long texts then come in small batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)
    return spark


def release() -> None:
    """Memory that Arrow and the C library hold free goes back to the system: Spark keeps more idle workers than it has cores."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def freeing(f):
    """For functions over Arrow batches: a worker gives free memory back when its task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, but only when Spark runs on this machine alone; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/gridlore-checkpoints"
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/gridlore/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later jobs read it, and no lost executor makes them redo what lies before."""
    path = shared_path(bounded_batches(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
