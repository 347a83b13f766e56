"""Helpers shared by the text operators: tables, shared scratch space, row sizes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; unset, a folder of this machine, which local runs alone may use."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]+(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='geoquarry-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote, once no later plan reads it."""
    path = getattr(df, "_stash_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def stash_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a stashed table."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._stash_path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


#: Stashed tables whose files are larger than this are joined by shuffle instead of broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """Broadcast a stashed table only where the bytes it takes are under the bound."""
    return F.broadcast(df) if stash_bytes(df) <= BROADCAST_BYTES else df


#: Rows of one Arrow batch in stages that hand whole texts to Python.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ARROW_ROWS rows at once to Python: texts are long, and JVM and worker each hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


_held: dict[Hashable, object] = {}


def worker_cache[T](key: Hashable, build: Callable[[], T]) -> T:
    """One object that a Python worker keeps for its next tasks; asking for another one lets the former go."""
    if key not in _held:
        release_worker_cache()
        _held[key] = build()
    return _held[key]


def release_worker_cache() -> None:
    """Let go of what an earlier stage kept in this worker: stages of one application share workers and their memory."""
    _held.clear()
    gc.collect()
    try:  # freed memory stays with the process until it is told to give it back
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
