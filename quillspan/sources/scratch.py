"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of the Arrow batches that go to a Python worker, about
_own: dict[str, str] = {}
_swept: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = folder = tempfile.mkdtemp(prefix="quillspan-core-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the driver process ends."""
    folder = f"{shared_folder(spark)}/quillspan-core/{spark.sparkContext.applicationId}"
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_sweep, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file access left
        with contextlib.suppress(Exception):  # nor has one whose JVM is going down
            _delete(spark, folder)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as 10,000 long texts are too many to hold as lists of words,
    unless the session has another value than the default."""
    if spark.conf.get(_BATCHES) == spark.newSession().conf.get(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no plan needs any more."""
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            _delete(t.sparkSession, path)
