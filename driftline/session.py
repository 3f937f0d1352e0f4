"""Session helpers shared by every job: shipping the package and durable cuts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at a time, at most: texts can be long, and a worker holds a batch whole.
BATCH_ROWS = 200


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions defined in it load there.

    The zip goes through Spark's own file server, once a session; nothing has
    to be installed on the workers. Arrow batches are kept small (BATCH_ROWS).
    """
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_driftline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="driftline-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("driftline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._driftline_shipped = True


def release(collect: bool = False) -> None:
    """Give memory that a Python worker no longer needs back to the machine: workers live on from task to task, and what allocators hold back adds up."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: list = []


def kept(key, make):
    """What a Python worker keeps from task to task: one object; asking for another drops it.

    A worker serves many operators one after the other, and their tables would
    add up.
    """
    if not _KEPT or _KEPT[0][0] != key:
        _KEPT.clear()
        release(collect=True)
        _KEPT.append((key, make()))
    return _KEPT[0][1]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine that names none (a test) gets a temporary one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(df: DataFrame) -> DataFrame:
    """Compute df once, as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def durable(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
